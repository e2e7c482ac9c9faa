"""Quality rules with risk-controlled thresholds.

Every document gets counts (words, symbols, repeated lines, words in repeated five-word windows) and
four shares made of them.  For each stratum (language) and share, a cutoff is selected on labelled
documents: going from the most lenient cutoff on, an exact (Clopper-Pearson) upper bound of the part
of good documents that the cutoff rejects must stay at or below ``alpha`` / number of rules; the
first cutoff that fails ends the sequence, so the order itself needs no correction, and the error
rate ``delta`` is divided among all strata and rules (Bonferroni).  With probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its good documents to the cutoffs.  Among the allowed cutoffs
the one is taken that rejects most bad documents, each good one counted ``good_weight`` times against
it; ties go to the most lenient.  A stratum with too few labels to prove anything gets no cutoff.

Cases: a null text has no words; a null stratum is a stratum of its own; labels that contradict each
other or are null are no evidence; repeated rows are judged one by one and alike; no labels or an
empty table leave the base rule alone; extra columns are ignored by ``judge`` and kept by ``keep``; a very
long text is counted whole, in memory that grows with its words.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpoint
from .arrow import append_columns, fresh
from .components import small

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ALPHA = 0.02
DELTA = 0.05
GOOD_WEIGHT = 20.0
TOP_BIN = 400  #: shares are cut at steps of 0.01; the last step takes all above
#: Beyond so many strata the cutoffs are joined by a shuffle instead of sent to each executor.
BROADCAST_STRATA = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    table: dict[bytes, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for w in words], np.int64)
    bits = max(1, (len(table) - 1).bit_length())
    code, size = ids[:n].copy(), bits
    for i in range(1, window):
        if size + bits > 62:  # number the windows anew before they outgrow an integer
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            size = max(1, n.bit_length())
        code, size = (code << bits) | ids[i : i + n], size + bits
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def count(text: str | None) -> list[int]:
    """The values of COUNTS for one text."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    again = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    return [
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(words),
        lines,
    ]


def with_counts(docs: DataFrame, text_col: str, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    fields = [T.StructField(prefix + c, T.LongType()) for c in COUNTS]
    return append_columns(docs, [text_col], fields, lambda texts: list(zip(*map(count, texts), strict=True)), keep)


def rules(prefix: str = "") -> dict[str, Column]:
    """The shares whose large values speak against a document."""
    c = {x: F.col(prefix + x) for x in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
    return {
        "symbols": c["n_symbols"] / words,
        "repeated_lines": c["n_dup_lines"] / lines,
        "repeated_words": c["n_repeat_words"] / words,
        "word_length": c["word_chars"] / words / 20,
    }


def base_failed(prefix: str = "") -> Column:
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * words)


def _bin(share: Column) -> Column:
    return F.least(F.floor(share * 100).cast("int"), F.lit(TOP_BIN))


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method): a few hundred steps for any size."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest rate at which k or fewer of n happen with probability ``delta`` or more: a quantile of the beta distribution."""
    if k >= n:
        return 1.0

    def chance(p: float) -> float:
        return beta_cdf(n - k, k + 1, 1 - p)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and chance(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def allowed_cutoff(bins: list[int], good: list[int], bad: list[int], n: int, limit: float, delta: float, good_weight: float) -> int | None:
    """The cutoff (reject at this bin or above) for one stratum and rule; None if none is allowed.

    ``good`` and ``bad`` count the labelled documents at each of ``bins``, in rising order.
    """
    best, best_value, k, caught = None, 0.0, 0, 0
    for b, g, x in sorted(zip(bins, good, bad, strict=True), reverse=True):
        if b == 0:
            break
        k, caught = k + g, caught + x
        if k / max(n, 1) > limit or upper_bound(k, n, delta) > limit:
            break
        if caught - good_weight * k > best_value:
            best, best_value = b, caught - good_weight * k
    return best


def cutoffs(counted: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """(stratum, one column per rule) with the selected cutoffs; null where there is none.

    ``counted`` has doc_id, stratum and COUNTS, ``labels`` doc_id and quality.  Documents that fail
    the base rule are left out: the cutoffs judge what it lets pass.  Only histograms of bounded size
    (strata x rules x bins) leave the first aggregation.
    """
    names = list(rules())
    votes = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    votes = votes.where("quality = most and quality in (0, 1)").select("doc_id", "quality")
    known = counted.where(~base_failed()).join(votes, "doc_id")
    shares = F.array(*[F.struct(F.lit(k).alias("rule"), _bin(v).alias("bin")) for k, v in rules().items()])
    bins = (
        known.select("stratum", "quality", F.explode(shares).alias("x"))
        .groupBy("stratum", "x.rule", "x.bin")
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    )
    bins = checkpoint(bins)
    tests = max(1, bins.select("stratum", "rule").distinct().count())

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"stratum": pdf["stratum"].iloc[0]}
        for rule in names:
            part = pdf[pdf["rule"] == rule].sort_values("bin")
            n = int(part["good"].sum())
            row[rule] = allowed_cutoff(part["bin"].tolist(), part["good"].tolist(), part["bad"].tolist(), n, alpha / len(names), delta / tests, good_weight)
        out = pd.DataFrame([row])
        out[names] = out[names].astype("Int64")
        return out

    schema = "stratum string, " + ", ".join(f"{r} long" for r in names)
    return checkpoint(bins.groupBy("stratum").applyInPandas(select, schema))


def _with_kept(counted: DataFrame, limits: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """Adds base_failed and kept; ``limits`` is sent to the executors where it is small."""
    names = fresh([*counted.columns, f"{prefix}base_failed", f"{prefix}kept"], "limit_stratum", *[f"limit_{r}" for r in rules()])
    limits = limits.select(*[F.col(c).alias(n) for c, n in zip(["stratum", *rules()], names, strict=True)])
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = counted.join(limits, F.col(f"`{stratum}`").eqNullSafe(F.col(names[0])), "left")
    over = [F.coalesce(_bin(v) >= F.col(n), F.lit(False)) for n, v in zip(names[1:], rules(prefix).values(), strict=True)]
    bad = reduce(lambda a, b: a | b, over)
    return joined.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}kept", ~base_failed(prefix) & ~bad)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    counted = checkpoint(with_counts(plain, "text", ["doc_id", "stratum"]))
    limits = cutoffs(counted, labels, **options)
    return _with_kept(counted, limits, "stratum").select("doc_id", *COUNTS[:-1], "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; each row is judged where it is read.

    Only documents with a label are counted to select cutoffs; all are counted to be judged.
    """
    columns = docs.columns
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    marked = small(checkpoint(labels.select("doc_id").where("doc_id is not null").distinct()))
    limits = cutoffs(with_counts(plain.join(marked, "doc_id", "left_semi"), "text", ["doc_id", "stratum"]), labels, **options)
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    again = docs.withColumn(f"{prefix}stratum", F.col(f"`{stratum_col}`").cast("string"))
    return _with_kept(with_counts(again, text_col, None, prefix), limits, f"{prefix}stratum", prefix).where(f"{prefix}kept").select(*[F.col(f"`{c}`") for c in columns])
