"""Listings, counts, keys and merges of the case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def case_filter(year: int | None = None, dispute_type: str | None = None, number: str | None = None) -> Column:
    test = F.lit(True)
    if year is not None:
        test = test & (F.col("roc_year") == year)
    if dispute_type:
        test = test & (F.col("dispute_type") == dispute_type)
    if number:
        test = test & F.contains("case_number", F.lit(number))
    return test


def list_cases(cases: DataFrame, page: int = 1, size: int = 20, **filters) -> DataFrame:
    """A page of the filtered cases, newest first; its size is at most 100."""
    page, size = max(page, 1), min(max(size, 1), 100)
    kept = cases.where(case_filter(**filters))
    return kept.orderBy(F.desc("decision_date"), F.desc("case_number"), "case_id").offset((page - 1) * size).limit(size)


def count_cases(cases: DataFrame, **filters) -> DataFrame:
    return cases.where(case_filter(**filters)).agg(F.count(F.lit(1)).alias("total"))


def get_cases(cases: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    return cases.join(ids.select("case_id").distinct(), "case_id", "left_semi").join(texts, "case_id")


def case_id_semi(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for cases (case_id, ordinal) in the caller's order, without blanks and repetitions."""
    wanted = ids.where(T.strip(F.col("case_id").cast("string")) != "").groupBy("case_id").agg(F.min("ordinal").alias("ordinal"))
    return cases.join(wanted, "case_id")


def chunk_case_join(embeddings: DataFrame, chunks: DataFrame, cases: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    return embeddings.where(F.col("embedding_model") == model).join(chunks, "chunk_id").join(cases, "case_id").join(summaries, "case_id", "left")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def common_chunks(embeddings: DataFrame, model_a: str, model_b: str) -> DataFrame:
    pick = lambda m, n: embeddings.where(F.col("embedding_model") == m).select("chunk_id", F.col("vector").alias(n))
    return pick(model_a, "vector_a").join(pick(model_b, "vector_b"), "chunk_id")


def dedupe_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key with the number of records that it stands for; of equally early ones always the same."""
    others = [c for c in records.columns if c != key]
    first = records.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("r"), F.count(F.lit(1)).alias("n"))
    return first.select(key, "r.*", (F.col("n") - 1).alias("duplicates"))


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New rows win, null values included; the `kept` columns of an existing row stay as they are."""
    a, b = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        take_new = F.col("n.__new").isNotNull() & (F.col("o.__old").isNull() if c in kept else F.lit(True))
        return F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*(pick(c) for c in old.columns))


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """old without the children of touched parents, and the new ones."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


REVIEW = ("review_status", "reviewer", "review_note", "reviewed_at")


def import_summaries(old: DataFrame, new: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged versions, one row of counts, rejected rows with the reason).

    A version is named by its case, model, prompt and source hash; reviews of existing versions stay. Generations with
    failed requests or a fallback merge, with a bad source hash, or of unknown cases are rejected.
    """
    known = new.join(cases.select("case_id").withColumn("__known", F.lit(True)), "case_id", "left")
    reason = F.when(F.col("__known").isNull(), "unknown_case").when(F.coalesce(F.col("failed_request_count"), F.lit(0)) > 0, "failed_requests").when(F.coalesce(F.col("final_merge_fallback"), F.lit(False)), "fallback_merge").when(~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_source_hash")
    checked = known.withColumn("reason", reason).drop("__known")
    good = checked.where("reason is null").withColumn("summary_id", T.summary_id(F.col("case_id"), F.col("model"), F.col("prompt_version"), F.col("source_sha256")))
    latest = good.withColumn("__n", F.row_number().over(Window.partitionBy("summary_id").orderBy(F.desc("generated_at")))).where("__n = 1").select(*old.columns)
    merged = upsert(old, latest, "summary_id", REVIEW + ("imported_at",))
    counts = latest.select("summary_id").join(old.select("summary_id").withColumn("__old", F.lit(1)), "summary_id", "left").agg(F.count(F.when(F.col("__old").isNull(), 1)).alias("inserted"), F.count("__old").alias("updated"))
    return merged, counts, checked.where("reason is not null")


def apply_reviews(versions: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """Set status, reviewer and note by summary_id; an unreviewed version has no review time, a reviewed one needs a reviewer."""
    ok = reviews.where(F.col("status").isin("unreviewed", "approved", "rejected") & ((F.col("status") == "unreviewed") | (T.strip(F.coalesce("new_reviewer", F.lit(""))) != "")))
    joined = versions.join(ok.select("summary_id", "status", "new_reviewer", "new_note"), "summary_id", "left")
    changed = F.col("status").isNotNull()
    value = {"review_status": F.col("status"), "reviewer": T.strip(F.col("new_reviewer")), "review_note": F.col("new_note"), "reviewed_at": F.when(F.col("status") != "unreviewed", now)}
    return joined.select(*(F.when(changed, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in versions.columns))


def latest_summary(versions: DataFrame) -> DataFrame:
    """One version of each case: approved before others, then the newest; rejected ones are hidden."""
    order = Window.partitionBy("case_id").orderBy((F.col("review_status") == "approved").desc(), F.desc("generated_at"), F.desc("imported_at"), "summary_id")
    best = versions.where("review_status != 'rejected'").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return best.withColumn("official", F.col("review_status") == "approved")


def review_queue(versions: DataFrame, cases: DataFrame) -> DataFrame:
    """Versions with their cases' numbers and their place: unreviewed, approved, others; newest first."""
    place = F.when(F.col("review_status") == "unreviewed", 0).when(F.col("review_status") == "approved", 1).otherwise(2)
    joined = versions.join(cases.select("case_id", "case_number"), "case_id").withColumn("status_order", place)
    return joined.orderBy("status_order", F.desc("generated_at"), "case_number", "summary_id")


def representative_sample(cases: DataFrame, summarised: DataFrame, limit: int, least_chars: int = 1000) -> DataFrame:
    """(case_id, pick): `limit` cases spread evenly over the order of text length, types unused so far first.

    cases: case_id, dispute_type, text_chars. Ranks come from counts per length. The greedy choice needs little: for each
    target the cases within `limit` ranks, and the nearest case of each of the limit + 1 nearest types, which are partial
    sums by type. No row is repeated by target before that.
    """
    rows = cases.where(F.col("text_chars") >= least_chars).join(summarised.select("case_id").distinct(), "case_id", "left_anti")
    sizes = rows.groupBy("text_chars").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("text_chars", F.coalesce(F.sum("n").over(Window.orderBy("text_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.join(before, "text_chars").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("text_chars").orderBy("case_id")) - 1)
    total = rows.count()
    limit = min(limit, total)
    if limit <= 0:
        return cases.sparkSession.createDataFrame([], f"case_id {cases.schema['case_id'].dataType.simpleString()}, pick int")
    targets = [0] if limit == 1 else [round(k * (total - 1) / (limit - 1)) for k in range(limit)]
    away = [F.abs(F.col("rank") - t) for t in targets]
    nearest = ranked.groupBy("dispute_type").agg(F.array(*(F.min(F.struct(d.alias("distance"), "case_id")) for d in away)).alias("each"))
    nearest = nearest.select("dispute_type", F.posexplode("each").alias("target", "m")).select("target", "m.case_id", "dispute_type", "m.distance")
    nearest = nearest.withColumn("c", F.row_number().over(Window.partitionBy("target").orderBy("distance", "case_id"))).where(F.col("c") <= limit + 1).drop("c")
    inside = F.array_compact(F.array(*(F.when(d <= limit, F.struct(F.lit(k).alias("target"), d.alias("distance"))) for k, d in enumerate(away))))
    around = ranked.withColumn("m", F.explode(inside)).select("m.target", "case_id", "dispute_type", "m.distance")
    rows_ = nearest.union(around).distinct().collect()
    used, types, out = set(), set(), []
    for t in range(limit):
        best = min((r for r in rows_ if r.target == t and r.case_id not in used), key=lambda r: (r.dispute_type in types, r.distance, r.case_id))
        used.add(best.case_id)
        types.add(best.dispute_type)
        out.append((best.case_id, t))
    return cases.sparkSession.createDataFrame(out, f"case_id {cases.schema['case_id'].dataType.simpleString()}, pick int")
