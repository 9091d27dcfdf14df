"""Measures of ranked results against relevance labels, and of annotators against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = ("relevant", "partially_relevant", "not_relevant")


def validate_results(results: DataFrame, k: int) -> DataFrame:
    """(query, violation): blank or repeated queries, other than k rows, absent or repeated chunk ids. results: query, query_no, rank, chunk_id."""
    blank = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    per = results.groupBy("query").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("query_no").alias("runs"), F.countDistinct("chunk_id").alias("ids"), F.max(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) == "").alias("no_id")
    )
    tests = [("blank_query", blank("query")), ("repeated_query", F.col("runs") > 1), ("row_count", F.col("rows") != k * F.col("runs")), ("missing_chunk_id", F.col("no_id")), ("repeated_chunk_id", (F.col("runs") == 1) & ~F.col("no_id") & (F.col("ids") < F.col("rows")))]
    return per.select("query", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("violation"))


def annotation_template(results: DataFrame) -> DataFrame:
    return results.select("query", "rank", "chunk_id", F.lit(None).cast("string").alias("label"), F.lit("").alias("evidence_summary"))


def is_complete() -> Column:
    return F.coalesce(F.col("label").isin(*LABELS) & (T.strip(F.coalesce("evidence_summary", F.lit(""))) != ""), F.lit(False))


def annotation_progress(annotations: DataFrame) -> DataFrame:
    """One row: rows, complete rows, and complete rows per label."""
    return annotations.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_complete(), 1)).alias("complete"), *(F.count(F.when(is_complete() & (F.col("label") == x), 1)).alias(x) for x in LABELS))


def pending_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.where(~is_complete()).select("query", "chunk_id")


def precision_per_query(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per query: k, relevant, partial, distinct cases, strict and lenient precision to four places."""
    joined = results.join(annotations.select("query", "chunk_id", "label"), ["query", "chunk_id"])
    per = joined.groupBy("query").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("label") == LABELS[0], 1)).alias("relevant"), F.count(F.when(F.col("label") == LABELS[1], 1)).alias("partial"), F.countDistinct("case_id").alias("unique_cases"))
    return per.withColumn("strict", F.round(F.col("relevant") / F.col("k"), 4)).withColumn("lenient", F.round((F.col("relevant") + F.col("partial")) / F.col("k"), 4))


def precision_at_k(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: micro precision over all rows, macro as the mean of the queries' rounded values."""
    per = precision_per_query(results, annotations)
    return per.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("k").alias("rows"), F.round(F.sum("relevant") / F.sum("k"), 4).alias("micro_strict"),
        F.round((F.sum("relevant") + F.sum("partial")) / F.sum("k"), 4).alias("micro_lenient"), F.round(F.avg("strict"), 4).alias("macro_strict"), F.round(F.avg("lenient"), 4).alias("macro_lenient"),
    )


def annotation_mismatches(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """(query, chunk_id, side) of results without an annotation and annotations without a result."""
    a, b = results.select("query", "chunk_id"), annotations.select("query", "chunk_id")
    return a.join(b, ["query", "chunk_id"], "left_anti").withColumn("side", F.lit("result")).unionByName(b.join(a, ["query", "chunk_id"], "left_anti").withColumn("side", F.lit("annotation")))


def confusion(first: DataFrame, second: DataFrame) -> DataFrame:
    """(label_a, label_b, n) for all nine pairs of labels; zeros included."""
    names = first.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    every = names.select(F.col("label").alias("label_a"), F.explode(F.array(*map(F.lit, LABELS))).alias("label_b"))
    joined = first.select("query", "chunk_id", F.col("label").alias("label_a")).join(second.select("query", "chunk_id", F.col("label").alias("label_b")), ["query", "chunk_id"])
    return every.join(joined.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")), ["label_a", "label_b"], "left").na.fill(0, ["n"])


def cohens_kappa(matrix: DataFrame) -> DataFrame:
    """One row: n, agreement and kappa to four places; kappa is null where chance alone agrees always."""
    margins = matrix.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("label_a").alias("label"), "n"), F.struct(F.lit("b").alias("side"), F.col("label_b").alias("label"), "n"))).alias("m")).select("m.*")
    product = margins.groupBy("label").agg((F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)) * F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0))).alias("p")).agg(F.sum("p").alias("chance"))
    totals = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    one = totals.withColumn("k", F.lit(1)).join(product.withColumn("k", F.lit(1)), "k")
    square = F.col("n") * F.col("n")
    kappa = F.when(square > F.col("chance"), F.round((F.col("same") * F.col("n") - F.col("chance")) / (square - F.col("chance")), 4))
    return one.select("n", F.when(F.col("n") > 0, F.round(F.col("same") / F.col("n"), 4)).alias("agreement"), kappa.alias("kappa"))


def annotator_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per query: rows, rows with equal labels and their share. Annotators must differ by name, whatever the case."""
    names = [r[0] for d in (first, second) for r in d.select(F.lower(T.strip(F.col("annotator")))).distinct().limit(2).collect()]
    if len(names) == 2 and names[0] == names[1]:
        raise ValueError("the annotators must differ")
    joined = first.select("query", "chunk_id", F.col("label").alias("a")).join(second.select("query", "chunk_id", F.col("label").alias("b")), ["query", "chunk_id"])
    return joined.groupBy("query").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same")).withColumn("agreement", F.round(F.col("same") / F.col("rows"), 4))


def label_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    joined = first.select("query", "chunk_id", F.col("label").alias("label_a")).join(second.select("query", "chunk_id", F.col("label").alias("label_b")), ["query", "chunk_id"])
    return joined.where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def suggestion_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query: strict precision before and after, and whether it improved."""
    joined = before.select("query", F.col("strict").alias("before")).join(after.select("query", F.col("strict").alias("after")), "query")
    return joined.withColumn("effect", F.when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "worse").otherwise("same"))
