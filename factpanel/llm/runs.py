"""Periodic runs of words by a harmonic grid over a suffix array.

A run is a stretch of consecutive words that repeats with a smallest period q, is at least
``max(least, power * q)`` words long and can't be made longer.  For each period p the words at the
multiples of p are compared with those p further on: how far they agree forwards and backwards (their
longest common extensions) gives the stretch that has period p around them.  A run of four periods
holds three grid points in a row whose neighbour is in it too, so every third one is asked, and n words
take about n/3 + n/6 + n/9 + ... questions.  An extension is the least entry of a range of the LCP array,
which a table of minima over powers of two answers at once; backwards the same is asked of the reversed
words' arrays.  A stretch found for several periods is kept for the least, which divides the others.

Many short texts share one array, with a word of its own behind each, so no extension leaves a text; a
longer one has its own.  Suffixes are sorted by doubling, whose steps also give the LCP array.

Cases: a null text is the empty text, with no words and no runs; a null id leaves the text as it is;
repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.  Of equally
long runs the first, then the one with the smaller period stands in the row.  A very long text is
worked on whole, in memory that grows with its words times their number's logarithm (1 GB for a million words).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns

LEAST = 6  #: words that a run has at least
POWER = 4  #: periods that a run has at least, 2 or more
QUESTIONS = 1 << 20  #: grid points that are asked at once
TOGETHER = 1 << 17  #: words of texts that share an array


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: cut at space and 0x09-0x0D


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the query's contract gives to a tenth of the ids: from word a on they repeat with period p."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


class Extensions:
    """Longest common extensions of two places of a sequence of numbers, both from there on."""

    def __init__(self, letters: np.ndarray) -> None:
        n = len(letters)
        # the rank of the 2^k letters from each place on, until all differ
        rank = np.unique(letters, return_inverse=True)[1].astype(np.int64)
        ranks, step, top = [rank], 1, int(rank.max()) + 1
        while top < n:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            top = int(new[-1]) + 1
            ranks.append(rank.astype(np.int32))
            step *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.place = rank.astype(np.int32)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        lcp = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(ranks) - 2, -1, -1):  # of the last step all ranks differ
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            lcp[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.minima = [lcp]
        while (1 << len(self.minima)) <= len(lcp):
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def ask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from ``i`` and from ``j`` on agree; the places differ."""
        x, y = self.place[i], self.place[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # the binary logarithm
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


def find_runs(letters: np.ndarray, sizes: Sequence[int], least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (text, start, end, period) in that order, of texts that stand in ``letters`` one behind the other.

    ``sizes`` are the texts' lengths; each text has a letter of its own behind it, which is the same nowhere else.
    """
    none = np.zeros((0, 4), np.int64)
    sizes = np.asarray(sizes, np.int64)
    n = len(letters)
    if not len(sizes) or int(sizes.max()) < least:
        return none
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    forward = backward = None
    found = [none]
    # the grid of a text and a period, a text's periods one behind the other
    most = sizes // power
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = max(1, power - 1)  # of so many grid points in a row a run has one
    points = -(-((sizes[text] - 1) // period) // stride)
    ends = np.cumsum(points)
    done = 0
    while done < len(text):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + QUESTIONS, side="right")))
        count = points[done:upto]
        of = np.repeat(np.arange(done, upto), count)
        k = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * stride
        p = period[of]
        i = begin[text[of]] + k * p
        j = i + p
        done = upto
        same = np.flatnonzero(letters[i] == letters[j])  # else they extend nowhere
        if not len(same):
            continue
        if forward is None:
            forward, backward = Extensions(letters), Extensions(letters[::-1])
        i, j, p, of = i[same], j[same], p[same], of[same]
        ahead = forward.ask(i, j)
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > begin[text[of]])
        back[inner] = backward.ask(n - i[inner], n - j[inner])  # the letters before i and j
        length = p + ahead + back
        long = np.flatnonzero(length >= np.maximum(least, power * p))
        start = i[long] - back[long]
        found.append(np.column_stack([text[of[long]], start, start + length[long], p[long]]))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    rows = rows[new]  # a stretch's least period
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 1:3] -= begin[rows[:, 0]][:, None]
    return rows


def runs_of(texts: Sequence[list[bytes]], least: int = LEAST, power: int = POWER) -> list[np.ndarray]:
    """For each text (a list of words) its runs as rows (start, end, period) by start, then period."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []

    def work() -> None:
        names: dict[bytes, int] = {}
        letters, sizes = [], []
        for t, words in enumerate(held):
            letters += [names.setdefault(w, len(names)) for w in words]
            letters.append(-1 - t)
            sizes.append(len(words))
        rows = find_runs(np.array(letters, np.int64), sizes, least, power)
        cuts = np.searchsorted(rows[:, 0], np.arange(1, len(held)))
        out.extend(part[:, 1:] for part in np.split(rows, cuts))
        held.clear()

    size = 0
    for words in texts:
        if held and size + len(words) > TOGETHER:
            work()
            size = 0
        held.append(words)
        size += len(words) + 1
    if held:
        work()
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER, plant: bool = False) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period) and ``collapsed``, the text without the repetitions, its words joined by one space.

    With ``plant`` the words are first changed as the query's contract says.
    """

    def work(ids: list, texts: list) -> list:
        words = [words_of(t) for t in texts]
        if plant:
            words = [planted(w, i) for w, i in zip(words, ids, strict=True)]
        found = runs_of(words, least, power)
        runs = [[{"start": s, "length": e - s, "period": p} for s, e, p in r.tolist()] for r in found]
        return [runs, [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]]

    return append_columns(docs, [id_col, text_col], [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], work)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of texts changed as the query's contract says."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = periodic_runs(plain, least=least, power=power, plant=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    values = {"start": F.col("x.s"), "length": -F.col("x.l"), "period": F.col("x.p"), "exponent_milli": F.floor(-1000 * F.col("x.l") / F.col("x.p")).cast("long")}
    return rows.withColumns(values).select("doc_id", *[f.name for f in FIELDS])
