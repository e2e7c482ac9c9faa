"""Company fact documents: JSON files scanned whole, and the facts in them.

A document is facts -> namespace -> tag -> units -> unit -> list of facts.  Its levels are opened one
after the other, each as a map from name to the text below it, so an odd value costs only itself, and
what no rule asks for is never parsed below its tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

FACT_FIELDS = ["val", "fy", "fp", "form", "filed", "accn", "frame", "start", "end"]
FACT = "struct<" + ",".join(f"{f}:string" for f in FACT_FIELDS) + ">"
MAP = "map<string,string>"
TOP = "struct<cik:string,facts:string,_corrupt:string>"
UNITS = f"map<string,array<{FACT}>>"
TAG = f"struct<label:string,description:string,units:{UNITS}>"
WHOLE = f"struct<cik:string,facts:map<string,map<string,{TAG}>>,_corrupt:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of JSON files, one row a file; ``path`` may hold a pattern."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c, F.lit(C.SPACES)).startswith("{"), F.lit(False))  # the end of a long text isn't looked at


def open_documents(documents: DataFrame) -> DataFrame:
    """Adds ``cik``, ``facts`` (text), ``status`` (ok, corrupt or no_facts) and ``file_key``.

    A document without the name ``facts`` is ok and empty; one where it isn't an object has no facts.
    """
    top = F.from_json("text", TOP, {"columnNameOfCorruptRecord": "_corrupt"})
    opened = documents.withColumn("__top", top)
    return opened.select(
        *documents.columns,
        F.col("__top.cik").alias("cik"),
        F.col("__top.facts").alias("facts"),
        _status(F.col("__top")).alias("status"),
        _key_of_file().alias("file_key"),
    )


def _status(top: Column) -> Column:
    corrupt = F.coalesce(top["_corrupt"].isNotNull(), F.lit(True)) | ~_is_object(F.col("text"))
    named = F.coalesce(F.array_contains(F.json_object_keys("text"), "facts"), F.lit(False))
    return F.when(corrupt, "corrupt").when(_is_object(top["facts"]), "ok").when(named, "no_facts").otherwise("ok")


def _key_of_file() -> Column:
    return C.company_key(F.regexp_extract("source_file", r"([^/]*?)(\.[^./]*)?\z", 1))


def explode_tags(opened: DataFrame) -> DataFrame:
    """(the input's other columns, namespace, tag, payload): a row for each tag that is an object."""
    keep = [c for c in opened.columns if c not in ("text", "facts")]
    spaces = opened.where("status = 'ok'").select(*keep, F.explode(F.from_json("facts", MAP)).alias("namespace", "__tags"))
    tags = spaces.where(_is_object(F.col("__tags"))).select(*keep, "namespace", F.explode(F.from_json("__tags", MAP)).alias("tag", "payload"))
    return tags.where(_is_object(F.col("payload")))


def explode_units(tags: DataFrame) -> DataFrame:
    """Adds ``unit``, ``unit_order`` and ``items`` (a list of texts, null where it isn't a list)."""
    keep = [c for c in tags.columns if c != "payload"]
    units = F.get_json_object("payload", "$.units")
    rows = tags.select(*keep, F.posexplode(F.from_json(F.when(_is_object(units), units), MAP)).alias("unit_order", "unit", "__list"))
    items = F.when(C.strip("__list").startswith("["), F.from_json("__list", "array<string>"))
    return rows.select(*keep, "unit", "unit_order", items.alias("items"))


def explode_facts(units: DataFrame) -> DataFrame:
    """A row for each fact that is an object, with FACT_FIELDS as text and ``fact_order``."""
    keep = [c for c in units.columns if c != "items"]
    rows = units.select(*keep, F.posexplode("items").alias("fact_order", "__fact")).where(_is_object(F.col("__fact")))
    return rows.select(*keep, "fact_order", F.from_json("__fact", FACT).alias("__f")).select(*keep, "fact_order", "__f.*")


def _tag_of(payload: Column) -> Column:
    """A tag's label, description and units, each read for itself."""
    units = F.get_json_object(payload, "$.units")
    lists = F.from_json(F.when(_is_object(units), units), MAP)
    items = lambda x: F.when(C.strip(x).startswith("["), F.from_json(x, "array<string>"))
    read = lambda x: F.transform(items(x), lambda fact: F.when(_is_object(fact), F.from_json(fact, FACT)))
    return F.struct(F.get_json_object(payload, "$.label").alias("label"), F.get_json_object(payload, "$.description").alias("description"), F.transform_values(lists, lambda _, x: read(x)).alias("units"))


def whole_documents(documents: DataFrame) -> DataFrame:
    """(source_file, file_key, cik, status, facts) of documents (source_file, text), each parsed once; ``status`` is that of ``open_documents``.

    ``facts`` maps a namespace to its tags and a tag to its label, description and units; a unit to its
    facts, null for what isn't an object, or to null if it has no list.  A document with a value of
    another kind somewhere is opened level by level, as ``explode_tags`` and ``explode_units`` do it, so
    an odd value still costs only itself.
    """
    parsed = documents.select("source_file", "text", F.from_json("text", WHOLE, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    regular = _is_object(F.col("text")) & F.col("p").isNotNull() & F.col("p._corrupt").isNull()
    top = F.from_json("text", TOP, {"columnNameOfCorruptRecord": "_corrupt"})
    odd = F.when(_is_object(F.col("text")) & top["_corrupt"].isNull() & _is_object(top["facts"]), F.from_json(top["facts"], MAP))
    opened = lambda tags: F.transform_values(F.map_filter(F.from_json(F.when(_is_object(tags), tags), MAP), lambda _, x: _is_object(x)), lambda _, x: _tag_of(x))
    layered = F.transform_values(odd, lambda _, x: opened(x))
    return parsed.select(
        "source_file",
        _key_of_file().alias("file_key"),
        F.when(regular, F.col("p.cik")).otherwise(top["cik"]).alias("cik"),
        F.when(regular & F.col("p.facts").isNotNull(), "ok").otherwise(_status(top)).alias("status"),
        F.when(regular, F.col("p.facts")).otherwise(layered).alias("facts"),
    )


def whole_tags(documents: DataFrame) -> DataFrame:
    """(source_file, cik, namespace, tag, label, description, units): a row for each tag of ``whole_documents``."""
    rows = whole_documents(documents).select("source_file", "cik", F.explode("facts").alias("namespace", "tags"))
    tags = rows.select("source_file", "cik", "namespace", F.explode("tags").alias("tag", "t")).where("t is not null")
    return tags.select("source_file", "cik", "namespace", "tag", "t.*")


def count_files(documents: DataFrame) -> DataFrame:
    return documents.select(F.count_distinct("source_file").alias("files"))
