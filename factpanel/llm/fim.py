"""Fill-in-middle by escaped marker injection, in built-in column functions.

The text's own delimiters are escaped, a delimiter is put behind every code point, and the number of
delimiters is the number of units.  ``substring_index`` takes what stands before the two cuts; the
parts are freed of delimiters and escapes and put together in the order of the form.

Cases: a null text is the empty text, which stays plain; a text that holds a marker stays plain, so
every output can be taken apart again; a null id draws as the empty id does; repeated rows draw alike;
an empty table gives no rows; extra columns are ignored.  A very long text is one row's string, marked
to about twice its size; work and memory grow with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
RATE, SPM = 90, 20  #: percent of the texts that are cut, and of those that begin with the suffix
SEED = 1
# A delimiter, what opens an escape, and the escapes of both; a unit is an escape or any other code point.
DELIMITER, ESCAPE = "\x01", "\x02"
ESCAPES = {ESCAPE: ESCAPE + "b", DELIMITER: ESCAPE + "a"}
UNIT = f"(?s)({ESCAPE}[ab]|.)"


def marked(text: Column) -> Column:
    """The text with a delimiter behind every unit."""
    for plain, escaped in ESCAPES.items():  # the escape's own sign comes first
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.regexp_replace(text, UNIT, "$1" + DELIMITER)


def unmarked(text: Column) -> Column:
    text = F.replace(text, F.lit(DELIMITER), F.lit(""))
    for plain, escaped in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that hang on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def between(text: Column, after: str, before: str | None = None) -> Column:
    """What stands behind the first ``after`` and, with ``before``, in front of the first one of that."""
    tail = F.substr(text, F.instr(text, after) + F.lit(len(after)))
    return tail if before is None else F.substring_index(tail, before, 1)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    psm = [between(output, PREFIX, SUFFIX), between(output, MIDDLE), between(output, SUFFIX, MIDDLE)]
    spm = [between(output, PREFIX, MIDDLE), between(output, MIDDLE), between(output, SUFFIX, PREFIX)]
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, text, output, form, n, prefix_chars, middle_chars), a row for each row of ``docs``; one pass, no shuffle."""
    source = F.col(f"`{id_col}`")
    rows = docs.select(source.alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.array(*draws(source, seed)).alias("h"))
    rows = rows.withColumn("marked", marked(F.col("text")))
    rows = rows.withColumn("n", F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit(""))))
    first, second = (F.col("h")[i] % (F.col("n") + 1) for i in range(2))
    rows = rows.select("*", F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    holds = F.lit(False)
    for m in MARKERS:
        holds = holds | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | holds | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    # substring_index leaves the delimiter behind the last unit away, so what follows begins two characters on
    head, reach = (F.call_function("substring_index", F.col("marked"), F.lit(DELIMITER), F.col(c)) for c in ("a", "b"))
    rows = rows.withColumn("form", form).withColumns({"head": head, "reach": reach})
    middle = F.when(F.col("a") == 0, F.col("reach")).otherwise(F.substr("reach", F.length("head") + F.lit(2)))
    tail = F.when(F.col("b") == 0, F.col("marked")).otherwise(F.substr("marked", F.length("reach") + F.lit(2)))
    parts = rows.withColumns({"prefix": unmarked(F.col("head")), "middle": unmarked(middle), "suffix": unmarked(tail)})
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm, spm_form = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_form).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    chars = {"prefix_chars": F.when(cut, F.col("a").cast("long")), "middle_chars": F.when(cut, (F.col("b") - F.col("a")).cast("long"))}
    return parts.withColumn("output", output).withColumns(chars).select("doc_id", "text", "output", "form", F.col("n").cast("long").alias("n"), *chars)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    made = transform(docs, id_col=id_col, text_col=text_col, seed=seed, rate=rate, spm=spm)
    hashes = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return made.withColumns(hashes).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def oracle_sql() -> str:
    """The same by positions in the text, for DuckDB."""
    h = ", ".join(f"CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    holds = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
r AS (SELECT doc_id, text, length(text) AS n, {h} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR {holds} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle) ELSE concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
