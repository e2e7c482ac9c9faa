import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factpanel.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \n\tab'sl1é\u0085 ")), max_size=60) | st.lists(
    st.sampled_from(["<|endoftext|>", " ", "  ", "word", "'ll", "\n", "é", "12", "😀", "漢"]), max_size=20
).map("".join)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.encode(text, packing.default_ranks()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([" ", "\n", " \t", "\u2003", "\x1c "]), st.integers(10_000, 10_100), TEXTS)
def test_long_space_is_cut_as_the_pattern_cuts_it(before, space, n, after):
    text = before + (space * n)[:n] + after
    whole = packing._encoder(packing.default_ranks(), True)
    got = packing._encode_around_space(text, packing._encoder(packing.default_ranks()), whole)
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000, "\n" * 2_000_000, " \t\n" * 500_000 + "x", "a" * 2_000_000, "é." * 500_000 + "\u3000" * 1_200_000 + "y"])
def test_no_text_is_too_long(text):
    assert packing.encode(text, packing.default_ranks()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [0]


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(1024) == [1024] and packing.piece_lengths(0) == []
    for n in random.Random(1).sample(range(1, 10_000), 200):
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths)
        assert lengths == sorted(lengths, reverse=True) and len([x for x in lengths if x < 1024]) == len({x for x in lengths if x < 1024})


def check(rows, documents):
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    for doc_id, text in documents:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in whole[doc_id]})
        at = 0
        for start, length, crc, total in pieces:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_query_against_the_library(spark, data):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(queries.op1_packing(spark, data).collect(), documents)


def test_odd_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert sum(r["doc_tokens"] == 1 for r in rows) == 2  # the null and the empty text: the end id alone
    assert packing.pack(no_documents).count() == 0
    again = packing.pack(odd_documents).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_ids_and_buckets(odd_documents, tmp_path, spark):
    packed = packing.pack(odd_documents, with_ids=True)
    for r in packed.collect():
        assert len(r["ids"]) == r["length"] == 1 << r["bucket"]
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("length <> shiftleft(1, bucket)").count() == 0
