"""Lookups of many ranges and of many words.

Ranges and words are lists of the configuration, held by the driver; the rows are read once, whatever
their number.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Beyond so many pieces the table of ranges is joined by a shuffle instead of sent to each executor.
BROADCAST_PIECES = 200_000


def disjoint(ranges: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Pieces without overlaps, in order: where ranges overlap, the first in the list holds; gaps stay gaps."""
    opens = sorted((low, i) for i, (low, high, _) in enumerate(ranges) if low <= high)
    bounds = sorted({low for low, _ in opens} | {ranges[i][1] + 1 for _, i in opens})
    out: list[tuple[int, int, str]] = []
    held: list[int] = []  # the ranges that are open, the first of the list on top
    at = 0
    for start, following in zip(bounds, bounds[1:], strict=False):
        while at < len(opens) and opens[at][0] == start:
            heapq.heappush(held, opens[at][1])
            at += 1
        while held and ranges[held[0]][1] < start:
            heapq.heappop(held)
        if held:
            label = ranges[held[0]][2]
            if out and out[-1][1] == start - 1 and out[-1][2] == label:
                out[-1] = (out[-1][0], following - 1, label)
            else:
                out.append((start, following - 1, label))
    return out


def with_label(df: DataFrame, value: Column, ranges: Sequence[tuple[int, int, str]], name: str, default: str | None = None) -> DataFrame:
    """``df`` with the label of the first range that holds a whole number; null and what lies in a gap get ``default``.

    Pieces without overlaps are put into bins about as wide as a piece is on average, so all pieces
    together have at most three times as many entries; a row looks into the one bin of its value.
    """
    pieces = disjoint(ranges)
    if not pieces:
        return df.withColumn(name, F.lit(default).cast("string"))
    low, high = pieces[0][0], pieces[-1][1]
    width = max(1, (high - low + 1) // len(pieces))
    rows = [(b, a, z, label) for a, z, label in pieces for b in range((a - low) // width, (z - low) // width + 1)]
    binned = df.sparkSession.createDataFrame(rows, "__bin long, __low long, __high long, __label string")
    # values outside all ranges and nulls have no bin, so they don't meet in one
    number = value.cast("long")
    bin_of = F.when((number >= low) & (number <= high), F.floor((number - low) / F.lit(width)).cast("long"))
    table = F.broadcast(binned) if len(rows) <= BROADCAST_PIECES else binned
    held = df.withColumn("__value", number).withColumn("__at", bin_of)
    on = (F.col("__at") == F.col("__bin")) & F.col("__value").between(F.col("__low"), F.col("__high"))
    return held.join(table, on, "left").withColumn(name, F.coalesce("__label", F.lit(default))).drop("__value", "__at", "__bin", "__low", "__high", "__label")


def trie_pattern(words: Iterable[str]) -> str:
    """A pattern that matches the longest of the words at a place; what words begin with alike is read once."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        tails = [re.escape(c) + pattern(child) for c, child in sorted(node.items()) if c]
        if not tails:
            return ""
        one = tails[0] if len(tails) == 1 and "" not in node else "(?:" + "|".join(tails) + ")"
        return one + "?" if "" in node else one

    return pattern(root)


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    """Whether the lower-case text contains a word anywhere, within other words too, in one reading."""
    lowered = F.lower(C.text(text))
    if not words:
        return F.lit(False)
    return F.lit(True) if "" in words else lowered.rlike(trie_pattern(words))


def words_in(text: Column | str, words: Sequence[str]) -> Column:
    """The words that the lower-case text contains anywhere, each once and in order, in one reading.

    At each place the longest word is taken; the shorter ones that it begins with hold there too.
    """
    known = sorted({w for w in words if w})
    if not known:
        return F.array().cast("array<string>")
    lowered = F.lower(C.text(text))
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({trie_pattern(known)}))"), F.lit(1)))
    within = {}
    names = set(known)
    for w in known:
        shorter = [w[:i] for i in range(1, len(w)) if w[:i] in names]
        if shorter:
            within[w] = shorter
    if not within:
        return F.array_sort(found)
    begun = F.map_from_arrays(F.array(*map(F.lit, within)), F.array(*[F.array(*map(F.lit, v)) for v in within.values()]))
    return F.array_sort(F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(begun, w), F.array().cast("array<string>")))))))
