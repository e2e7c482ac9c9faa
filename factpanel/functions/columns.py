"""Column functions of the company-fact panel: built-in expressions only, no Python UDFs.

Missing is null here; blank text counts as missing where a function says so.  Parsing never fails: a
text that doesn't parse is null, whatever spark.sql.ansi.enabled says.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_ANNUAL = 99
LAG_UNKNOWN = 999_999
ANNUAL_DAYS = (300, 400)
NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INTEGER = r"([+-]?\d+)(?:\.0*)?"
DATE = r"(\d{4}-\d{2}-\d{2})"
#: What counts as white space in text.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(c).cast("string"), F.lit(SPACES))


def _within_spaces(c: Column | str, pattern: str) -> Column:
    """The group of a pattern that a text holds between white space, else null: one reading, which nothing repeats.

    Null reaches no cast; one that fails is an exception within, which costs more than all the rest.
    """
    return F.get(F.regexp_extract_all(col(c).cast("string"), F.lit(rf"^[{SPACES}]*+{pattern}[{SPACES}]*\z"), F.lit(1)), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def text(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def zero_pad(c: Column | str, width: int) -> Column:
    """Zeros in front up to ``width``, behind a sign; longer texts stay as they are."""
    c = col(c).cast("string")
    signed = F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, 2, width), width - 1, "0"))
    padded = F.when(c.rlike(r"^[+-]"), signed).otherwise(F.lpad(c, width, "0"))
    return F.when(F.length(c) < width, padded).otherwise(c)


def company_key(c: Column | str, *, strict: bool = False) -> Column:
    """A ten-digit key from digits with or without CIK in front; else null, or an error if strict."""
    digits = F.regexp_extract(F.upper(strip(c)), r"^(?:CIK)?\s*(\d{1,10})\z", 1)
    found = F.when(digits != "", F.lpad(digits, 10, "0"))
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("invalid company key: "), text(c))))


def company_key_or_file(c: Column | str, file_name: Column | str) -> Column:
    """The key as it stands, padded; null takes the file's name without folder, CIK and ending."""
    stem = F.regexp_replace(F.regexp_extract(col(file_name), r"([^/]*?)(\.[^./]*)?\z", 1), "CIK", "")
    plain = F.regexp_replace(strip(c), r"^(?i:CIK)", "")
    return F.when(col(c).isNull(), stem).otherwise(zero_pad(plain, 10))


def first_item(c: Column | str, separator: str = ";") -> Column:
    """The first non-blank item of a list in text form; the empty text if there is none."""
    items = F.filter(F.transform(F.split(text(c), separator), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))


def join_items(c: Column | str, separator: str = ";") -> Column:
    return F.coalesce(F.array_join(col(c), separator), F.lit(""))


def distinct_set(c: Column | str) -> Column:
    """An aggregate: the distinct non-blank values in order, as a list."""
    return F.array_sort(F.collect_set(F.nullif(col(c).cast("string"), F.lit(""))))


def merged_sets(c: Column | str) -> Column:
    """An aggregate of lists of distinct values: all their values in order, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(col(c)))))


def distinct_join(c: Column | str, separator: str = ";") -> Column:
    """An aggregate: the distinct non-blank values in order, joined."""
    return F.array_join(distinct_set(c), separator)


def first_name(*names: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(n) for n in names], F.lit(""))


def number(c: Column | str) -> Column:
    """A finite double, or null; unlike a cast it takes no type letters, NaN or infinity."""
    return _within_spaces(c, NUMBER).try_cast("double")


def invalid_number(c: Column | str) -> Column:
    """Whether a non-blank text isn't a number."""
    return F.coalesce((strip(c) != "") & number(c).isNull(), F.lit(False))


def integer(c: Column | str) -> Column:
    """A whole number as a long, or null; 2020 and 2020.0 are whole."""
    return _within_spaces(c, INTEGER).try_cast("long")


def industry_code(c: Column | str) -> Column:
    """An industry code as an integer; decimals are cut off."""
    return number(c).try_cast("int")


def between(c: Column | str, low: float, high: float) -> Column:
    """Inclusive; false for null."""
    return F.coalesce(col(c).between(low, high), F.lit(False))


def label_of_range(c: Column | str, ranges: Sequence[tuple[int, int, str]], default: str | None = None) -> Column:
    """The label of the first range that holds the value."""
    out = None
    for low, high, label in ranges:
        hit = between(c, low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out if default is None else out.otherwise(default)


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """Whether the lower-case text contains a word anywhere, within other words too."""
    lowered = F.lower(text(c))
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def iso_date(c: Column | str) -> Column:
    """A date from YYYY-MM-DD, else null.  Compact and week forms aren't taken."""
    return _within_spaces(c, DATE).try_cast("date")


def date_number(c: Column | str) -> Column:
    d = iso_date(c)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0))


def period_days(start: Column | str, end: Column | str) -> Column:
    """Days of a period, both ends counted."""
    return F.datediff(iso_date(end), iso_date(start)) + 1


def lag_days(filed: Column | str, end: Column | str) -> Column:
    return F.datediff(iso_date(filed), iso_date(end))


def known_lag_days(filed: Column | str, end: Column | str) -> Column:
    """The lag where it is known and not negative, else LAG_UNKNOWN."""
    lag = lag_days(filed, end)
    return F.coalesce(F.when(lag >= 0, lag), F.lit(LAG_UNKNOWN))


def is_annual_period(start: Column | str, end: Column | str) -> Column:
    return between(period_days(start, end), *ANNUAL_DAYS)


def frame_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"^CY(\d{4})(?:Q4I)?\z", 1), F.lit(""))


def is_annual_frame(c: Column | str) -> Column:
    return text(c).rlike(r"^CY\d{4}(Q4I)?\z")


def company_year(fy: Column | str, frame: Column | str, end: Column | str) -> Column:
    """The fiscal year, else the frame's year, else the end's year, else the fiscal year as text."""
    return F.coalesce(integer(fy).cast("string"), frame_year(frame), F.year(iso_date(end)).cast("string"), text(fy))


def inventory_year(fy: Column | str, end: Column | str) -> Column:
    """The fiscal year as it stands, else the first four digits of the end, else the empty text."""
    start = F.when(text(end).rlike(r"^\d{4}"), F.substring(text(end), 1, 4))
    return F.coalesce(F.nullif(col(fy).cast("string"), F.lit("")), start, F.lit(""))


def annual_rank(is_flow: Column, fp: Column | str, start: Column | str, end: Column | str, frame: Column | str, form: Column | str, forms: Sequence[str]) -> Column:
    """How surely a fact is annual: 0 best, NON_ANNUAL not at all."""
    annual = is_annual_period(start, end)
    instant = F.upper(text(form)).isin(*forms) & (text(end) != "") & (text(start) == "")
    return (
        F.when(is_flow, F.when(annual, 0).otherwise(NON_ANNUAL))
        .when(F.upper(text(fp)) == "FY", 0)
        .when(annual, 1)
        .when(is_annual_frame(frame), 2)
        .when(instant, 3)
        .otherwise(NON_ANNUAL)
    )


def form_rank(form: Column | str, forms: Sequence[str]) -> Column:
    """The place among accepted forms, or their number; white space isn't taken off."""
    at = F.array_position(F.array(*[F.lit(f) for f in forms]), F.upper(text(form))).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(forms))


def fp_rank(fp: Column | str) -> Column:
    return F.when(F.upper(text(fp)) == "FY", 0).otherwise(1)


def _match_rank(value: Column, year: Column) -> Column:
    return F.when(value.isNull(), 1).when(value == year, 0).otherwise(2)


def fy_match_rank(fy: Column | str, year: Column | str) -> Column:
    return _match_rank(integer(fy).cast("string"), col(year))


def frame_match_rank(frame: Column | str, year: Column | str) -> Column:
    return _match_rank(frame_year(frame), col(year))


def period_match_rank(fy: Column | str, frame: Column | str, year: Column | str) -> Column:
    """0 frame and fiscal year match, 1 fiscal year, 2 frame, 3 both are absent, 4 else."""
    year = col(year)
    by_fy = F.coalesce(integer(fy).cast("string") == year, F.lit(False))
    by_frame = F.coalesce(frame_year(frame) == year, F.lit(False))
    absent = integer(fy).isNull() & frame_year(frame).isNull()
    return F.when(by_fy & by_frame, 0).when(by_fy, 1).when(by_frame, 2).when(absent, 3).otherwise(4)


def is_true(c: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(c, F.lit(False))


def differs(actual: Column | str, expected: Column | str, tolerance: float) -> Column:
    """Both known, and further apart than the tolerance times the expected (one at least)."""
    actual, expected = col(actual), col(expected)
    return is_true(F.abs(actual - expected) > F.greatest(F.abs(expected), F.lit(1.0)) * tolerance)


def with_six_digits(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with doubles as texts of six significant digits, as %.6g writes them; null as the empty text.

    A value exactly between two such numbers goes to the even one.  What only its shortest decimal
    form puts between them goes up, where %.6g may go down.  Each step is a projection of its own, so
    that nothing is computed twice and all of it is compiled.
    """
    columns = df.columns
    prefix = "six"
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    at = {name: f"{prefix}_{i}_" for i, name in enumerate(values)}

    def step(df: DataFrame, make) -> DataFrame:
        return df.withColumns({p + part: c for name, p in at.items() for part, c in make(lambda part, p=p: F.col(p + part), name).items()})

    def exact(x, name: str) -> dict[str, Column]:
        # the shortest decimal form, filled with zeros: one digit, the point, sixteen digits, the power
        c = values[name].cast("double")
        return {"c": c, "exact": F.when(F.abs(c) < float("inf"), F.format_string("%.16e", F.abs(c)))}  # else no digits: they would fail to parse, one by one

    def parts(x, name: str) -> dict[str, Column]:
        digits = F.concat(F.substring(x("exact"), 1, 1), F.substring(x("exact"), 3, 16))
        return {"head": F.substring(digits, 1, 6).try_cast("long"), "rest": F.substring(digits, 7, 11), "power": F.substring(x("exact"), 20, 5).try_cast("int")}  # behind the e

    def rounded(x, name: str) -> dict[str, Column]:
        c, half = x("c"), F.lit("50000000000")
        tie_down = (x("rest") == half) & (x("head") % 2 == 0) & (c * 1024 == F.floor(c * 1024))
        return {"number": x("head") + F.when((x("rest") >= half) & ~tie_down, 1).otherwise(0)}

    def carried(x, name: str) -> dict[str, Column]:
        over = x("number") == 1_000_000
        return {"digits": F.when(over, "100000").otherwise(x("number").cast("string")), "place": x("power") + F.when(over, 1).otherwise(0)}

    def shown(x, name: str) -> dict[str, Column]:
        digits, power = x("digits"), x("place")
        cut = lambda t: F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))  # noqa: E731  of a text with a point
        size = F.abs(power).cast("string")
        science = F.concat(cut(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        plain = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        return {"text": F.when((power < -4) | (power >= 6), science).when(power < 0, cut(small)).otherwise(cut(plain))}

    def signed(x) -> Column:
        c = x("c")
        odd = F.when(c.isNull(), "").when(c == 0, "0").when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        return odd.when(c < 0, F.concat(F.lit("-"), x("text"))).otherwise(x("text"))

    for make in (exact, parts, rounded, carried, shown):
        df = step(df, make)
    return df.select(*[F.col(f"`{c}`") for c in columns if c not in values], *[signed(lambda part, p=p: F.col(p + part)).alias(name) for name, p in at.items()])


def utc_stamp(clock: Column | str) -> Column:
    """A time as an ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(col(clock), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def year_of_utc(clock: Column | str) -> Column:
    return F.year(F.to_utc_timestamp(col(clock), F.current_timezone()))


def year_of_utc_now() -> Column:
    return year_of_utc(F.current_timestamp())
