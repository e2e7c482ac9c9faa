"""Secret scans with a randomness test battery, in DataFrame functions only.

Base kinds are patterns with positions.  The method adds kind ``random``: long runs of key-like
characters are read in the encoding that fits them best (hex, base32, letters and digits, base64) and
tested for chi-squared uniformity over its alphabet, runs about the alphabet's middle and lag-one
serial correlation.  The score is the largest of the three deviations in standard units; a small one
looks random.  The corpus's own sentences and, for longer runs, lines, with everything but their letters
left out, are the null cases: a run's p-value is the part of null cases of its length class that score
as low.  Each length class has its own Benjamini-Hochberg threshold at ``q``, found on histograms of
scores of bounded size.

Positions are code points, ends exclusive.  They come from ``split``, whose parts between matches are
as long as what the matches leave out.

Cases: a null text is the empty text; texts without a match have zero counts and an empty list; runs of
equal scores are flagged or not together;
repeated rows are scanned alike; too few null cases to reach ``q`` add nothing; an empty table gives no rows;
extra columns are ignored by ``scan`` and kept by ``redact``; a very long text is scanned whole, and the
places of its matches are added up by blocks, so the work grows with its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import checkpoint
from .arrow import fresh

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more characters with its first four
HEX = r"[0-9a-f]{24,}"
LONG = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ASSIGN_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]
LENGTHS = [20, 24, 32, 48, 64, 96, 128, 192, 256, 512]  #: lower ends of the length classes
LINES_FROM = 96  #: null cases from so many letters on are lines, shorter ones sentences
BLOCK = 64  #: matches whose places are added up together
TOP_BIN = 1200
BINS_PER_UNIT = 20
Q = 0.01
MARK = "[secret]"

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: (pattern, alphabet) of each encoding, the narrowest first
ENCODINGS = [
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z2-7]+=*$", LOWER.upper() + "234567="),
    (r"^[A-Za-z]+$", LOWER + LOWER.upper()),
    (r"^[A-Za-z0-9]+$", "0123456789" + LOWER.upper() + LOWER),
    (r".", "0123456789+/_-=" + LOWER.upper() + LOWER),
]


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, left to right."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], one).alias("spans"))

    def of_blocks(blocks: Column) -> Column:
        """Blocks' own places moved by the lengths of the blocks before, so that no fold copies all matches again and again."""
        none = F.array().cast("array<int>")
        add = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets"))
        offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("offsets")), add, lambda acc: acc["offsets"])
        move = lambda by: lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return F.flatten(F.zip_with(blocks, offsets, lambda x, by: F.transform(x["spans"], move(by))))

    def of_rows(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))
        fold = lambda at: F.aggregate(F.slice(rows, at, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)
        return _let(F.transform(starts, fold), of_blocks)

    rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("part"), found.alias("match"), values.alias("value"))
    return F.when(text.rlike(pattern), _let(rows, of_rows)).otherwise(empty)


def score(run: Column) -> Column:
    """The largest deviation from randomness of a run, in standard units."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, symbols in ENCODINGS[-2::-1]:
        alphabet = F.when(run.rlike(pattern), symbols).otherwise(alphabet)
    return _let(F.struct(F.split(run, "").alias("chars"), alphabet.alias("alphabet")), _battery)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _battery(x: Column) -> Column:
    codes = F.transform(F.filter(x["chars"], lambda c: c != ""), lambda c: F.instr(x["alphabet"], c).cast("double"))
    return _let(F.struct(codes.alias("v"), F.length(x["alphabet"]).cast("double").alias("k")), _tests)


def _tests(x: Column) -> Column:
    zero = F.lit(0.0)
    names = ["previous", "n", "changes", "high", "total", "squares", "products"]

    def step(a: Column, v: Column) -> Column:
        high, was = (v > x["k"] / 2).cast("double"), (a["previous"] > x["k"] / 2).cast("double")
        first = a["n"] == 0
        return F.struct(
            v.alias("previous"),
            (a["n"] + 1).alias("n"),
            (a["changes"] + F.when(first | (high == was), 0.0).otherwise(1.0)).alias("changes"),
            (a["high"] + high).alias("high"),
            (a["total"] + v).alias("total"),
            (a["squares"] + v * v).alias("squares"),
            (a["products"] + F.when(first, 0.0).otherwise(v * a["previous"])).alias("products"),
        )

    sums = F.aggregate(x["v"], F.struct(*[zero.alias(n) for n in names]), step)

    def same(a: Column, v: Column) -> Column:
        run = F.when(v == a["last"], a["run"] + 1).otherwise(1.0)
        return F.struct(v.alias("last"), run.alias("run"), (a["squares"] + 2 * run - 1).alias("squares"))  # adds up run lengths squared

    ties = F.aggregate(F.array_sort(x["v"]), F.struct(F.lit(-1.0).alias("last"), zero.alias("run"), zero.alias("squares")), same, lambda a: a["squares"])
    row = F.struct(
        sums.alias("s"), ties.alias("ties"), x["k"].alias("k"), F.element_at(x["v"], 1).alias("first"), F.element_at(x["v"], -1).alias("last")
    )
    return _let(row, _deviation)


def _deviation(x: Column) -> Column:
    s, k = x["s"], x["k"]
    n = s["n"]
    chi, df = x["ties"] * k / n - n, k - 1
    uniform = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
    low = n - s["high"]
    pairs = 2 * s["high"] * low
    spread = F.sqrt(F.greatest(pairs * (pairs - n), F.lit(0.0)) / (n * n * (n - 1)))
    runs = F.when(spread > 0, F.abs(1 + s["changes"] - 1 - pairs / n) / spread).otherwise(n)
    mean = s["total"] / n
    variance = s["squares"] - n * mean * mean
    products = s["products"] - mean * (2 * s["total"] - x["first"] - x["last"]) + (n - 1) * mean * mean
    serial = F.when(variance > 0, F.abs(products / variance + 1 / n) * F.sqrt(n)).otherwise(n)
    return F.greatest(uniform, runs, serial)


def _length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(length >= low, i).otherwise(out)
    return out


def _classed(found: Column, length: Column) -> list[Column]:
    b = F.floor(F.greatest(found, F.lit(0.0)) * BINS_PER_UNIT).cast("int")
    return [_length_class(length).alias("class"), F.least(b, F.lit(TOP_BIN)).alias("bin")]


def candidates(text: Column) -> Column:
    """array<struct<start, end, class, bin>> of the long runs of a text."""

    def tested(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), *_classed(score(x["value"]), x["end"] - x["start"]))

    return F.transform(matches(text, LONG, "random"), tested)


def null_cases(texts: DataFrame) -> DataFrame:
    """(class, bin) of the sentences and the longer lines of ``texts`` (column text), letters only.

    The same sums as for runs, taken with text functions instead of a fold: how often a letter comes
    up, how often a low one follows a high one, and only the products of neighbours letter by letter.
    """
    kept = F.lower(F.regexp_replace("text", r"[^A-Za-z.!?\n]+", ""))
    sentences = F.filter(F.split(kept, r"[.!?\n]+"), lambda x: F.length(x).between(LENGTHS[0], LINES_FROM - 1))
    lines = F.filter(F.split(F.regexp_replace(kept, "[.!?]+", ""), r"\n+"), lambda x: F.length(x) >= LINES_FROM)
    rows = texts.select(F.explode(F.concat(sentences, lines)).alias("letters")).withColumn("size", F.length("letters").cast("double"))

    def times(what: str, of: str) -> Column:
        return (F.col("size") - F.length(F.replace(F.col(of), F.lit(what), F.lit("")))) / len(what)

    half = len(LOWER) // 2
    rows = rows.withColumns({f"n_{c}": times(c, "letters") for c in LOWER})
    rows = rows.withColumn("bits", F.translate("letters", LOWER, "0" * half + "1" * half))
    rows = rows.withColumn("codes", F.transform(F.slice(F.split("letters", ""), F.lit(1), F.col("size").cast("int")), lambda x: (F.ascii(x) - 96).cast("double")))
    pairs = F.col("size").cast("int") - 1
    neighbours = F.zip_with(F.slice("codes", F.lit(1), pairs), F.slice("codes", F.lit(2), pairs), lambda a, b: a * b)

    def weighted(power: int) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"n_{c}") * float((i + 1) ** power) for i, c in enumerate(LOWER)])

    sums = F.struct(
        F.col("size").alias("n"),
        (times("01", "bits") + times("10", "bits")).alias("changes"),
        times("1", "bits").alias("high"),
        weighted(1).alias("total"),
        weighted(2).alias("squares"),
        F.aggregate(neighbours, F.lit(0.0), lambda a, b: a + b).alias("products"),
    )
    ties = reduce(lambda a, b: a + b, [F.col(f"n_{c}") * F.col(f"n_{c}") for c in LOWER])
    row = F.struct(sums.alias("s"), ties.alias("ties"), F.lit(float(len(LOWER))).alias("k"), F.element_at("codes", 1).alias("first"), F.element_at("codes", -1).alias("last"))
    return rows.withColumn("row", row).select(*_classed(_deviation(F.col("row")), F.col("size")))


def thresholds(runs: DataFrame, texts: DataFrame, q: float = Q) -> dict[int, int]:
    """The last bin that is flagged, by length class.

    ``runs`` has ``class`` and ``bin`` of the candidates, ``texts`` the corpus in column ``text``.
    Only (class, bin) counts are gathered: a few thousand rows for any corpus.
    """
    null = null_cases(texts).withColumn("null", F.lit(True))
    both = null.unionByName(runs.select("class", "bin", F.lit(False).alias("null")))
    counts = both.groupBy("class", "bin").agg(F.count_if("null").alias("null"), F.count_if(~F.col("null")).alias("open"))
    upto, whole = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    p = (1 + F.sum("null").over(upto)) / (1 + F.sum("null").over(whole))
    rank = F.try_divide(F.sum("open").over(upto), F.sum("open").over(whole))
    held = counts.select("class", "bin", p.alias("p"), rank.alias("rank")).where(F.col("p") <= q * F.col("rank"))
    return {r["class"]: r["bin"] for r in held.groupBy("class").agg(F.max("bin").alias("bin")).collect()}


def _base(text: Column) -> Column:
    """The spans of the base kinds: array<struct<start, rank, end>>."""

    def of(kind: str, pattern: str) -> Column:
        spans = matches(text, pattern, kind)
        if kind == "assign":
            spans = F.filter(spans, lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))

    return F.array_sort(F.concat(of("assign", ASSIGN), of("access", ACCESS), of("hex", HEX)))


def _added(base: Column, runs: Column, limits: dict[int, int]) -> Column:
    """Base spans and the flagged runs that none of them overlaps."""

    def flagged(x: Column) -> Column:
        low = F.lit(False)
        for k, b in limits.items():
            low = low | ((x["class"] == k) & (x["bin"] <= b))
        return low & ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))

    more = F.transform(F.filter(runs, flagged), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end")))
    return F.array_sort(F.concat(base, more))


def _line(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")


def _equals(rank: int):
    return lambda x: F.when(x == rank, True)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), a row for each document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = checkpoint(docs.select(F.col(f"`{id_col}`").alias("doc_id"), _base(text).alias("base"), candidates(text).alias("runs")))
    limits = thresholds(found.select(F.explode("runs").alias("x")).select("x.*"), docs.select(text.alias("text")), q)
    spans = _added(F.col("base"), F.col("runs"), limits)
    ranks = F.transform("base", lambda x: x["rank"])
    number = {k: F.size(F.array_compact(F.transform(ranks, _equals(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])}
    return found.select("doc_id", "base", spans.alias("all")).select(
        "doc_id",
        *number.values(),
        F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_random"),
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", q: float = Q, mark: str = MARK) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; a null text stays null."""
    text = F.col(f"`{text_col}`")
    base, found, changed = fresh(docs.columns, "base", "spans", "redacted")
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    limits = thresholds(texts.select(F.explode(candidates(F.col("text"))).alias("x")).select("x.*"), texts, q)
    spans = docs.withColumn(base, _base(text)).withColumn(found, _added(F.col(base), candidates(text), limits))
    out = spans.withColumn(changed, F.when(F.size(found) > 0, _without(text, F.col(found), mark)).otherwise(text))
    named = {text_col: F.col(changed)}
    if chars_col and chars_col in docs.columns:
        named[chars_col] = F.when(F.size(found) > 0, F.length(changed)).otherwise(F.col(f"`{chars_col}`")).cast(docs.schema[chars_col].dataType)
    return out.select(*[named.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
