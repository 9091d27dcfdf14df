"""Audits of records and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import keyword_like


def mojibake_audit(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of every field with replacement characters or Cyrillic letters."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    return df.select(key, F.expr(f"stack({len(fields)}, {pairs}) as (field, value)")).where(T.is_mojibake(F.col("value")))


REQUIRED = ("case_number", "decision_date", "dispute_type", "pdf_url", "case_directory")


def metadata_audit(records: DataFrame, url_prefix: str, order: str = "seq") -> DataFrame:
    """(seq, violation) of records: absent fields, repeated numbers, links elsewhere, unresolved batches."""
    blank = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    first = Window.partitionBy("case_number").orderBy(order)
    # records without a number are no one's repetition, and many: they aren't put in one order
    numbered = records.where(~blank("case_number")).withColumn("__n", F.row_number().over(first))
    placed = numbered.unionByName(records.where(blank("case_number")).withColumn("__n", F.lit(None).cast("int")))
    tests = [(f"missing_{c}", blank(c)) for c in REQUIRED]
    tests += [("duplicate_case_number", F.coalesce(F.col("__n") > 1, F.lit(False))), ("url_prefix", ~blank("pdf_url") & ~F.col("pdf_url").startswith(url_prefix)), ("unresolved_batch", ~F.coalesce(F.col("batch_status").isin("ok", "no_results"), F.lit(False)))]
    return placed.select(order, F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("violation"))


def batch_reconcile(batches: DataFrame, records: DataFrame, key: str = "case_number") -> DataFrame:
    """One row: records that the good batches report, records there are, distinct and repeated ones, and whether they agree."""
    expected = batches.agg(F.coalesce(F.sum(F.when(F.col("status").isin("ok", "partial"), F.col("reported"))), F.lit(0)).cast("long").alias("expected"))
    # counts per record first, so that the single last row is made of partial sums
    per = records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("unique"))
    one = expected.withColumn("k", F.lit(1)).join(per.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("duplicates", F.col("raw") - F.col("unique")).withColumn("reconciled", F.col("raw") == F.col("expected"))


def keyword_hit_counts(cases: DataFrame, keywords: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, n): rows with each keyword, zeros included."""
    hits = keyword_like(cases, keywords, columns, []).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return keywords.select("query_id").join(hits, "query_id", "left").na.fill(0, ["n"])


def corpus_verify(counts: dict[str, tuple[DataFrame, int]], cases: DataFrame, chunks: DataFrame, embeddings: DataFrame, least_chars: int = 1) -> DataFrame:
    """(check, actual, expected, passed): table counts, children without parents and the reverse, shortest chunk, dimensions.

    Every table is read once: its rows say what they know of an id (a case, a chunk or a number of dimensions), and one grouping
    by these ids, added up in each task first, answers all checks. No observed metrics are used, since a task that is run again
    after an executor was lost would count twice. Null ids meet nothing: such a case has no chunks, such a chunk no vector.
    """
    known = {id(cases): "cases", id(chunks): "chunks", id(embeddings): "vectors"}
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")

    def says(kind: str, key: str, **what):
        """A fact about an id; null ids are told apart from every id."""
        fields = [what.get(c, none).cast("long").alias(c) for c in ("cases", "chunks", "vectors", "chars")]
        return F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(key).isNull().alias("unknown"), *fields)

    facts = [
        cases.select(says("case", "case_id", cases=one).alias("f")),
        # a chunk counts once, with its own id, and is there for its case
        chunks.select(F.explode(F.array(says("chunk", "chunk_id", chunks=one, chars=F.col("chunk_chars")), says("case", "case_id", chunks=one))).alias("f")),
        embeddings.select(F.explode(F.array(says("chunk", "chunk_id", vectors=one), says("dims", "dims", vectors=one))).alias("f")),
    ]
    facts += [df.select(F.struct(F.lit(f"table {t}").alias("kind"), F.lit("").alias("id"), F.lit(False).alias("unknown"), one.alias("cases"), none.alias("chunks"), none.alias("vectors"), none.alias("chars")).alias("f")) for t, (df, _) in counts.items() if id(df) not in known]
    rows = facts[0]
    for r in facts[1:]:
        rows = rows.unionByName(r)
    by = rows.select("f.*").groupBy("kind", "id", "unknown").agg(*(F.sum(c).alias(c) for c in ("cases", "chunks", "vectors")), F.min("chars").alias("chars"))

    def total(kind: str, column: str, where=None):
        on = F.col("kind") == kind
        return F.coalesce(F.sum(F.when(on if where is None else on & where, F.col(column))), F.lit(0).cast("long"))

    kinds = {"cases": total("case", "cases"), "chunks": total("chunk", "chunks"), "vectors": total("chunk", "vectors")}
    checks = [(f"count_{t}", kinds[known[id(df)]] if id(df) in known else total(f"table {t}", "cases"), n, "=") for t, (df, n) in counts.items()]
    checks += [
        ("cases_without_chunks", total("case", "cases", F.col("chunks").isNull() | F.col("unknown")), 0, "="),
        ("chunks_without_vectors", total("chunk", "chunks", F.col("vectors").isNull() | F.col("unknown")), 0, "="),
        ("shortest_chunk", F.coalesce(F.min("chars"), F.lit(0).cast("long")), least_chars, ">="),
        ("kinds_of_dims", F.count(F.when((F.col("kind") == "dims") & ~F.col("unknown"), 1)), 1, "="),
    ]
    answers = by.agg(*(a.alias(f"c{k}") for k, (_, a, _, _) in enumerate(checks)))
    told = [F.struct(F.lit(name).alias("check"), F.col(f"c{k}").alias("actual"), F.lit(n).cast("long").alias("expected"), (F.col(f"c{k}") == n if sign == "=" else F.col(f"c{k}") >= n).alias("passed")) for k, (name, _, n, sign) in enumerate(checks)]
    return answers.select(F.explode(F.array(*told)).alias("r")).select("r.*")
