"""Counts over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def overview_stats(cases: DataFrame, year: int | None = None) -> DataFrame:
    """One row: cases, distinct non-blank types, earliest and latest date (all of the year, if given), and every year there is."""
    own = F.lit(True) if year is None else F.col("roc_year") == year
    kind = F.when(own & (T.strip(F.coalesce("dispute_type", F.lit(""))) != ""), F.col("dispute_type"))
    return cases.agg(
        F.count(F.when(own, 1)).alias("total_cases"), F.countDistinct(kind).alias("dispute_types"), F.min(F.when(own, F.col("decision_date"))).alias("first_date"),
        F.max(F.when(own, F.col("decision_date"))).alias("last_date"), F.array_join(F.array_sort(F.collect_set("roc_year")).cast("array<string>"), ",").alias("years"),
    )


def dispute_type_counts(cases: DataFrame, year: int | None = None) -> DataFrame:
    kept = cases if year is None else cases.where(F.col("roc_year") == year)
    return kept.where(T.strip(F.coalesce("dispute_type", F.lit(""))) != "").groupBy("dispute_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dispute_type")


def organize_counts(cases: DataFrame) -> DataFrame:
    """Counts by year and by type in one pass over the input (grouping sets)."""
    sets = cases.groupingSets([["roc_year"], ["dispute_type"]], "roc_year", "dispute_type")
    return sets.agg(F.grouping("roc_year").cast("int").alias("by_type"), F.count(F.lit(1)).alias("n"))


def chunk_stats(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: cases, chunks, fewest and most chunks of a case that has some, and cases without chunks."""
    per = chunks.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    joined = cases.select("case_id").join(per, "case_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"), F.count(F.when(F.col("n").isNull(), 1)).alias("empty_cases"))


def hint_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("section_hint", F.lit("(none)")).alias("section_hint")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section_hint")


def embedding_inventory(embeddings: DataFrame) -> DataFrame:
    """Per model: vectors, least and most dimensions, and whether they differ."""
    per = embeddings.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"), F.min("dims").alias("min_dims"), F.max("dims").alias("max_dims"))
    return per.withColumn("mixed", F.col("min_dims") != F.col("max_dims"))


def inventory_errors(inventory: DataFrame, model: str, dims: int) -> DataFrame:
    """(error) rows for a model that isn't stored, is stored with mixed dimensions, or with others than `dims`."""
    own = inventory.where(F.col("embedding_model") == model).agg(F.count(F.lit(1)).alias("c"), F.max("mixed").alias("mixed"), F.max("max_dims").alias("d"))
    tests = [("none_stored", F.col("c") == 0), ("mixed_dims", F.coalesce("mixed", F.lit(False))), ("dims_differ", F.coalesce(F.col("d") != dims, F.lit(False)))]
    return own.select(F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("error"))


def summary_field_stats(summaries: DataFrame, fields: list[str], foreign: str = r"\A\z.") -> DataFrame:
    """Per field: filled rows, least, median, average and greatest length, and how many hold a later heading.

    Lengths are counted in each task first, so what meets is a row for each field and length, of which there are as many as
    the longest text has characters at most; the median is exact.
    """
    long = summaries.select(F.expr(f"stack({len(fields)}, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in fields)}) as (field, value)"))
    size = F.when(F.coalesce("value", F.lit("")) != "", F.char_length("value"))
    counted = long.groupBy("field", size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").rlike(foreign), 1)).alias("contaminated"))
    sized = F.when(F.col("size").isNotNull(), F.col("n")).otherwise(0)
    every = Window.partitionBy("field")
    ranked = counted.withColumn("filled", F.sum(sized).over(every)).withColumn("upto", F.sum(sized).over(every.orderBy(F.asc_nulls_first("size"))))
    # the length at a place is the least up to which so many rows have been counted
    at = lambda place: F.min(F.when(F.col("size").isNotNull() & (F.col("upto") >= place), F.col("size")))
    middle = (at(F.floor((F.col("filled") + 1) / 2)) + at(F.floor(F.col("filled") / 2) + 1)) / 2
    return ranked.groupBy("field").agg(
        F.max("filled").alias("filled"), F.min("size").alias("min_chars"), middle.alias("median_chars"), F.round(F.sum(F.col("size") * F.col("n")) / F.max("filled"), 2).alias("avg_chars"),
        F.max("size").alias("max_chars"), F.sum("contaminated").alias("contaminated"),
    )
