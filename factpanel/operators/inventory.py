"""An inventory of the tags that company documents use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import facts, schemas


def tag_inventory(documents: DataFrame) -> DataFrame:
    """(namespace, tag, label, description, units, forms, company_count, company_year_count, fact_count) of documents (source_file, text).

    A company counts as soon as it has the tag; a unit as soon as it is named; ``fact_count`` takes the
    lengths of the lists, with whatever is in them.  Label and description are the first non-empty
    ones in order of file.  A document is parsed once and its tags, units and facts are opened in one
    pass; distinct companies and years are counted by grouping from a company's year to the tag.
    """
    keys = ["namespace", "tag"]
    tags = facts.whole_tags(documents).withColumn("cik10", C.company_key_or_file("cik", "source_file"))
    units = tags.select("cik10", "source_file", *keys, "label", "description", F.explode_outer("units").alias("unit", "items"))
    opened = units.select("*", F.posexplode_outer("items").alias("place", "fact"))
    year = F.when(F.col("fact").isNotNull(), C.inventory_year("fact.fy", "fact.end"))

    def first_text(c: str):
        return F.min(F.when(C.text(c) != "", F.struct("source_file", F.col(c).alias("v")))).alias(c)

    size = F.when(F.coalesce(F.col("place"), F.lit(0)) == 0, F.coalesce(F.array_size("items"), F.lit(0))).otherwise(0)
    texts, lists = ["label", "description"], ["units", "forms"]
    by_year = opened.groupBy("cik10", *keys, year.alias("year")).agg(
        *map(first_text, texts), C.distinct_set("unit").alias("units"), C.distinct_set("fact.form").alias("forms"), F.sum(size.cast("long")).alias("fact_count")
    )
    merged = [*[F.min(c).alias(c) for c in texts], *[C.merged_sets(c).alias(c) for c in lists], F.sum("fact_count").alias("fact_count")]
    by_company = by_year.groupBy("cik10", *keys).agg(*merged, F.count_if(F.col("year") != "").alias("years"))
    whole = by_company.groupBy(*keys).agg(*merged, F.count("cik10").alias("company_count"), F.sum("years").alias("company_year_count"))
    shown = {c: F.coalesce(F.col(c)["v"], F.lit("")) for c in texts} | {c: F.array_join(c, ";") for c in lists}
    return whole.withColumns(shown).select(*schemas.INVENTORY).orderBy(*keys)
