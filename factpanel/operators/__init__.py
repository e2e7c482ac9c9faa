"""Relational operators over companies, facts and panels."""
