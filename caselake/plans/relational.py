"""Queries on the case tables: listings, joins, counts, merges, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import embed, evaluate, quality, search, stats
from ..sources import stored
from ..sources.shared import shared_folder
from . import bindings as D
from .bindings import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(with_sql(D.CASES) + "SELECT case_id, case_number, decision_date FROM cases WHERE roc_year = 107 AND dispute_type = 'src7' ORDER BY decision_date DESC, case_number DESC LIMIT 20 OFFSET 0")
def list_cases(spark, sf):
    return C.list_cases(D.cases(spark, sf), 1, 20, year=107, dispute_type="src7").select("case_id", "case_number", "decision_date")


@query(with_sql(D.CASES) + "SELECT count(*) AS total FROM cases WHERE contains(case_number, '42')")
def count_cases(spark, sf):
    return C.count_cases(D.cases(spark, sf), number="42")


@query(with_sql(D.CASES) + "SELECT case_id, case_number, md5(text) AS digest FROM cases WHERE case_id IN (SELECT item_id FROM benchmark)")
def get_case(spark, sf):
    c = D.cases(spark, sf, text=True)
    ids = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    return C.get_cases(c.drop("text", "n_chars"), c.select("case_id", "text"), ids).select("case_id", "case_number", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(with_sql(D.CASES) + "SELECT case_id, min(item_id) AS ordinal FROM cases JOIN benchmark ON case_id = item_id * 7 GROUP BY 1")
def case_id_semi(spark, sf):
    b = D.table(spark, sf, "benchmark").select((F.col("item_id") * 7).alias("case_id"), F.col("item_id").alias("ordinal"))
    return C.case_id_semi(D.cases(spark, sf), b.union(b.withColumn("ordinal", F.col("ordinal") + 1000))).select("case_id", "ordinal")


@query(with_sql(D.CASES) + "SELECT c.case_id, c.dispute_type, l.toxic FROM cases c LEFT JOIN labels l ON l.doc_id = c.case_id")
def case_profile_join(spark, sf):
    from ..operators.similar import case_profiles

    return case_profiles(D.cases(spark, sf), D.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), "toxic")).select("case_id", "dispute_type", "toxic")


def _models(spark, sf):
    """Two models' vectors: the given ones, and for two of three chunks the same ones turned round."""
    k = D.chunks(spark, sf).select("chunk_id", "vector")
    b = k.where("chunk_id % 3 != 0").withColumn("vector", F.reverse("vector"))
    named = lambda d, m: d.select("chunk_id", F.lit(m).alias("embedding_model"), F.size("vector").alias("dims"), "vector")
    return named(k, "a").unionByName(named(b, "b"))


MODELS = "models AS (SELECT chunk_id, 'a' AS embedding_model, len(vector) AS dims FROM chunks UNION ALL SELECT chunk_id, 'b', len(vector) FROM chunks WHERE chunk_id % 3 <> 0)"


@query(with_sql(D.CASES, D.CHUNKS, MODELS) + "SELECT m.chunk_id, case_id, c.case_number, l.toxic FROM models m JOIN chunks USING (chunk_id) JOIN cases c USING (case_id) LEFT JOIN labels l ON l.doc_id = case_id WHERE embedding_model = 'b'")
def chunk_case_join(spark, sf):
    k = D.chunks(spark, sf).select("chunk_id", "case_id", "chunk_index")
    s = D.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), "toxic")
    return C.chunk_case_join(_models(spark, sf), k, D.cases(spark, sf), s, "b").select("chunk_id", "case_id", "case_number", "toxic")


@query(with_sql(D.CHUNKS, MODELS) + "SELECT chunk_id, case_id, chunk_index FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM models WHERE embedding_model = 'b')")
def missing_embeddings(spark, sf):
    return embed.missing_embeddings(D.chunks(spark, sf), _models(spark, sf), "b").select("chunk_id", "case_id", "chunk_index")


@query(with_sql(D.CASES, D.CHUNKS) + "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM chunks)")
def orphans(spark, sf):
    return C.orphans(D.cases(spark, sf), D.chunks(spark, sf), "case_id").select("case_id")


@query(with_sql(D.CASES, D.VERSIONS) + "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM versions)")
def exclude_summarized(spark, sf):
    return C.orphans(D.cases(spark, sf), D.versions(spark, sf), "case_id").select("case_id")


@query(with_sql(D.CHUNKS) + "SELECT chunk_id, round(CAST(vector[1] AS DOUBLE), 6) AS a0, round(CAST(vector[-1] AS DOUBLE), 6) AS b0 FROM chunks WHERE chunk_id % 3 <> 0")
def common_chunks_two_models(spark, sf):
    return C.common_chunks(_models(spark, sf), "a", "b").select("chunk_id", F.round(F.col("vector_a")[0].cast("double"), 6).alias("a0"), F.round(F.col("vector_b")[0].cast("double"), 6).alias("b0"))


@query("SELECT item_id AS query_id, trim(split_part(text, ' ', 1)) AS original_query, 'the ' || lower(trim(split_part(text, ' ', 1))) AS suggested_query, 'r' AS rule_id, FALSE AS auto_apply FROM benchmark WHERE trim(split_part(text, ' ', 1)) IN (SELECT split_part(text, ' ', 1) FROM benchmark WHERE item_id % 2 = 0)")
def query_suggestion_lookup(spark, sf):
    b = D.table(spark, sf, "benchmark").select("item_id", F.split("text", " ")[0].alias("w"))
    rules = b.where("item_id % 2 = 0").select(F.col("w").alias("original_query"), F.concat(F.lit("the "), F.lower("w")).alias("suggested_query"), F.lit("r").alias("rule_id")).distinct()
    return search.query_suggestions(b.select(F.col("item_id").alias("query_id"), F.concat(F.lit(" "), F.col("w"), F.lit("\t")).alias("query")), rules)


@query(with_sql(D.CASES) + "SELECT count(*) FILTER (roc_year = 103) AS total_cases, count(DISTINCT dispute_type) FILTER (roc_year = 103 AND trim(dispute_type) <> '') AS dispute_types, min(decision_date) FILTER (roc_year = 103) AS first_date, max(decision_date) FILTER (roc_year = 103) AS last_date, array_to_string(list_sort(list(DISTINCT roc_year)), ',') AS years FROM cases")
def overview_stats(spark, sf):
    return stats.overview_stats(D.cases(spark, sf), 103)


@query(with_sql(D.CASES) + "SELECT dispute_type, count(*) AS n FROM cases WHERE trim(coalesce(dispute_type, '')) <> '' GROUP BY 1")
def dispute_type_counts(spark, sf):
    return stats.dispute_type_counts(D.cases(spark, sf))


@query(with_sql(D.CASES) + "SELECT roc_year, dispute_type, CAST(grouping(roc_year) AS INTEGER) AS by_type, count(*) AS n FROM cases GROUP BY GROUPING SETS ((roc_year), (dispute_type))")
def organize_counts(spark, sf):
    return stats.organize_counts(D.cases(spark, sf))


@query(with_sql(D.CHUNKS, MODELS) + "SELECT embedding_model, count(*) AS n, CAST(min(dims) AS INTEGER) AS min_dims, CAST(max(dims) AS INTEGER) AS max_dims, min(dims) <> max(dims) AS mixed FROM models GROUP BY 1")
def embedding_inventory(spark, sf):
    return stats.embedding_inventory(_models(spark, sf))


@query("SELECT field, count(n) AS filled, CAST(min(n) AS INTEGER) AS min_chars, median(n) AS median_chars, round(avg(n), 2) AS avg_chars, CAST(max(n) AS INTEGER) AS max_chars, count(*) FILTER (regexp_matches(value, '\\d{3}')) AS contaminated FROM (SELECT field, value, CASE WHEN value <> '' THEN length(value) END AS n FROM (SELECT 'url' AS field, url AS value FROM pages UNION ALL SELECT 'html', html FROM pages)) GROUP BY 1")
def summary_field_stats(spark, sf):
    return stats.summary_field_stats(D.table(spark, sf, "pages"), ["url", "html"], r"\d{3}")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) - 1 AS duplicates FROM orders GROUP BY 1")
def dedupe_records(spark, sf):
    return C.dedupe_records(D.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def _orders(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    old = o.where("o_orderkey % 3 != 0").withColumn("created_at", F.lit("old"))
    new = o.where("o_orderkey % 2 = 0").withColumn("created_at", F.lit("new")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, "X"))
    return old, new


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (CASE WHEN o_orderkey % 4 <> 0 THEN 'X' END) ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS created_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""
)
def upsert_cases(spark, sf):
    old, new = _orders(spark, sf)
    return C.upsert(old, new, "o_orderkey")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (CASE WHEN o_orderkey % 4 <> 0 THEN 'X' END) ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS created_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""
)
def upsert_stored_cases(spark, sf):
    """The merge into a stored table, in two batches."""
    old, new = _orders(spark, sf)
    path = shared_folder(spark, "stored-cases")
    stored.create(old, path, "o_orderkey", 16)
    for k in (0, 1):
        stored.merge(new.where(F.col("o_orderkey") % 4 == 2 * k), path, batch=k)
    return stored.read(spark, path)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM lineitem")
def replace_case_chunks(spark, sf):
    items = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    new = items.where("l_orderkey % 5 = 0")
    return C.replace_children(items.withColumn("version", F.lit("old")), new.withColumn("version", F.lit("new")), new, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM lineitem")
def replace_stored_chunks(spark, sf):
    """The replacement in a stored table."""
    items = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    new = items.where("l_orderkey % 5 = 0")
    path = shared_folder(spark, "stored-chunks")
    stored.create(items.withColumn("version", F.lit("old")), path, "l_orderkey", 16)
    stored.replace(new.withColumn("version", F.lit("new")), new, path)
    return stored.read(spark, path)


@query(with_sql(D.VERSIONS) + "SELECT case_id, summary_id, review_status, review_status = 'approved' AS official FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY review_status = 'approved' DESC, generated_at DESC, imported_at DESC, summary_id) AS rn FROM versions WHERE review_status <> 'rejected') WHERE rn = 1")
def latest_summary(spark, sf):
    return C.latest_summary(D.versions(spark, sf)).select("case_id", "summary_id", "review_status", "official")


@query(with_sql(D.CASES, D.VERSIONS) + "SELECT summary_id, case_number, CASE review_status WHEN 'unreviewed' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END AS status_order FROM versions JOIN cases USING (case_id)")
def review_queue(spark, sf):
    return C.review_queue(D.versions(spark, sf), D.cases(spark, sf)).select("summary_id", "case_number", "status_order")


def _summaries(spark, sf):
    v = D.versions(spark, sf)
    full = v.select("summary_id", "case_id", F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), F.sha2("summary_id", 256).alias("source_sha256"), "generated_at", "imported_at", "review_status", F.lit("r").alias("reviewer"), F.lit(None).cast("string").alias("review_note"), F.lit("t").alias("reviewed_at"))
    from ..functions.text import summary_id

    return full.withColumn("summary_id", summary_id(F.col("case_id").cast("string"), F.col("model"), F.col("prompt_version"), F.col("source_sha256")))


@query(
    with_sql(D.CASES, D.VERSIONS)
    + """, v AS (SELECT 'aisum_' || sha256(concat_ws(chr(31), CAST(case_id AS VARCHAR), 'm', 'v1', sha256(summary_id)))[1:24] AS summary_id, case_id, review_status, CAST(split_part(summary_id, '_', 2) AS BIGINT) AS turn FROM versions)
 SELECT summary_id, case_id, CASE WHEN turn % 2 = 0 THEN review_status ELSE 'unreviewed' END AS review_status, CASE WHEN turn % 3 = 0 AND case_id IN (SELECT case_id FROM cases) THEN 'new' ELSE 'old' END AS generated
 FROM v WHERE turn % 2 = 0 OR (turn % 3 = 0 AND case_id IN (SELECT case_id FROM cases))""".replace("WITH ", "", 1)
)
def import_summaries(spark, sf):
    """Every other version is there; every third comes anew, unreviewed, and keeps an old one's review."""
    turn = F.split(F.col("key"), "_")[1].cast("bigint")
    every = _summaries(spark, sf).withColumn("key", F.concat_ws("_", "case_id", F.lit("0")))
    rows = D.versions(spark, sf).select(F.sha2("summary_id", 256).alias("source_sha256"), F.col("summary_id").alias("key"))
    every = every.drop("key").join(rows, "source_sha256")
    columns = ["summary_id", "case_id", "model", "prompt_version", "source_sha256", "generated_at", "imported_at", "review_status", "reviewer", "review_note", "reviewed_at"]
    old = every.where(turn % 2 == 0).select(*columns).withColumn("generated_at", F.lit("old"))
    new = every.where(turn % 3 == 0).select(*columns).withColumns({"review_status": F.lit("unreviewed"), "generated_at": F.lit("new"), "failed_request_count": F.lit(0), "final_merge_fallback": F.lit(False)}).drop("summary_id")
    merged, _, _ = C.import_summaries(old, new, D.cases(spark, sf))
    return merged.select("summary_id", "case_id", "review_status", F.col("generated_at").alias("generated"))


@query(
    with_sql(D.VERSIONS)
    + "SELECT summary_id, CASE WHEN case_id % 3 = 0 THEN 'approved' WHEN case_id % 3 = 1 THEN 'unreviewed' ELSE review_status END AS review_status, CASE WHEN case_id % 3 = 0 THEN 'ann' WHEN case_id % 3 = 1 THEN '' ELSE 'r' END AS reviewer, CASE WHEN case_id % 3 = 0 THEN 'now' WHEN case_id % 3 = 1 THEN NULL ELSE 't' END AS reviewed_at FROM versions"
)
def apply_reviews(spark, sf):
    v = D.versions(spark, sf).withColumns({"reviewer": F.lit("r"), "review_note": F.lit(""), "reviewed_at": F.lit("t")})
    status = F.when(F.col("case_id") % 3 == 0, "approved").when(F.col("case_id") % 3 == 1, "unreviewed").otherwise("nonsense")
    reviews = v.select("summary_id", status.alias("status"), F.when(F.col("case_id") % 3 == 0, " ann ").otherwise("").alias("new_reviewer"), F.lit("").alias("new_note"))
    return C.apply_reviews(v, reviews, F.lit("now")).select("summary_id", "review_status", "reviewer", "reviewed_at")


@query(
    with_sql(D.CASES, D.VERSIONS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, r AS (SELECT case_id, coalesce(dispute_type, '') AS ty, row_number() OVER (ORDER BY n_chars, case_id) - 1 AS rank FROM cases WHERE n_chars >= 1000 AND case_id NOT IN (SELECT case_id FROM versions)), n AS (SELECT count(*) AS n FROM r),
 picks(pick, case_id, used, types) AS (SELECT -1, CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[])
  UNION ALL SELECT pick + 1, b.id, list_append(used, b.id), list_append(types, b.ty) FROM (SELECT p.pick, p.used, p.types, arg_min({'id': r.case_id, 'ty': r.ty}, (list_contains(p.types, r.ty), abs(r.rank - round((p.pick + 1) * (n - 1) / 9.0)), r.case_id)) AS b FROM picks p, r, n WHERE p.pick < 9 AND NOT list_contains(p.used, r.case_id) GROUP BY 1, 2, 3))
 SELECT case_id, pick FROM picks WHERE pick >= 0""".replace(", r AS", ", r AS", 1)
)
def representative_sample(spark, sf):
    c = D.cases(spark, sf, text=True).select("case_id", "dispute_type", F.col("n_chars").alias("text_chars"))
    return C.representative_sample(c, D.versions(spark, sf).select("case_id"), 10)


def _ranked(spark, sf):
    """Results and labels: for a query vector the ten chunks of its own and the next blocks of ids, labelled by label distance."""
    k = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("case_id"), "label")
    q = k.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("q"), F.col("label").alias("own"))
    rows = q.select("q", "own", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("chunk_id", F.col("q") + F.col("rank")).join(k, "chunk_id")
    d = F.abs(F.col("label") - F.col("own"))
    label = F.when(d == 0, "relevant").when(d == 1, "partially_relevant").otherwise("not_relevant")
    second = F.when((F.col("chunk_id") + F.col("rank")) % 9 == 0, "not_relevant").otherwise(label)
    return rows.select(F.col("q").cast("string").alias("query"), F.col("q").alias("query_no"), "rank", "chunk_id", "case_id", label.alias("label"), second.alias("second"), F.when(F.col("chunk_id") % 11 == 0, "").otherwise("seen").alias("evidence_summary"))


RANKED = """ranked AS (SELECT CAST(q AS VARCHAR) AS query, q AS query_no, rank, r.chunk_id, k.case_id, CASE abs(k.label - own) WHEN 0 THEN 'relevant' WHEN 1 THEN 'partially_relevant' ELSE 'not_relevant' END AS label,
 CASE WHEN (r.chunk_id + rank) % 9 = 0 THEN 'not_relevant' ELSE CASE abs(k.label - own) WHEN 0 THEN 'relevant' WHEN 1 THEN 'partially_relevant' ELSE 'not_relevant' END END AS second, CASE WHEN r.chunk_id % 11 = 0 THEN '' ELSE 'seen' END AS evidence_summary
 FROM (SELECT vec_id AS q, label AS own, CAST(rank AS INTEGER) AS rank, vec_id + rank AS chunk_id FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS rank FROM embeddings WHERE vec_id % 20 = 0)) r JOIN (SELECT vec_id AS chunk_id, vec_id // 5 AS case_id, label FROM embeddings) k ON k.chunk_id = r.chunk_id)"""


@query(with_sql(RANKED) + "SELECT query, 'row_count' AS violation FROM ranked WHERE query_no % 40 <> 0 OR rank <> 3 GROUP BY 1 HAVING count(*) <> 5")
def validate_results(spark, sf):
    return evaluate.validate_results(_ranked(spark, sf).where("query_no % 40 != 0 or rank != 3"), 5)


@query(with_sql(RANKED) + "SELECT query, rank, chunk_id, CAST(NULL AS VARCHAR) AS label, '' AS evidence_summary FROM ranked")
def annotation_template(spark, sf):
    return evaluate.annotation_template(_ranked(spark, sf))


@query(with_sql(RANKED) + "SELECT count(*) AS total, count(*) FILTER (evidence_summary <> '') AS complete, count(*) FILTER (evidence_summary <> '' AND label = 'relevant') AS relevant, count(*) FILTER (evidence_summary <> '' AND label = 'partially_relevant') AS partially_relevant, count(*) FILTER (evidence_summary <> '' AND label = 'not_relevant') AS not_relevant FROM ranked")
def annotation_progress(spark, sf):
    return evaluate.annotation_progress(_ranked(spark, sf))


PER = "per AS (SELECT query, count(*) AS k, count(*) FILTER (label = 'relevant') AS relevant, count(*) FILTER (label = 'partially_relevant') AS partial, count(DISTINCT case_id) AS unique_cases, round(count(*) FILTER (label = 'relevant') / count(*), 4) AS strict, round(count(*) FILTER (label IN ('relevant', 'partially_relevant')) / count(*), 4) AS lenient FROM ranked GROUP BY 1)"


@query(with_sql(RANKED, PER) + "SELECT * FROM per")
def precision_per_query(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.precision_per_query(r.drop("label"), r)


@query(with_sql(RANKED, PER) + "SELECT count(*) AS queries, CAST(sum(k) AS BIGINT) AS rows, round(sum(relevant) / sum(k), 4) AS micro_strict, round((sum(relevant) + sum(partial)) / sum(k), 4) AS micro_lenient, round(avg(strict), 4) AS macro_strict, round(avg(lenient), 4) AS macro_lenient FROM per")
def precision_at_k(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.precision_at_k(r.drop("label"), r)


@query(with_sql(RANKED) + "SELECT query, chunk_id, 'result' AS side FROM ranked WHERE chunk_id % 4 = 0 UNION ALL SELECT query, chunk_id, 'annotation' FROM ranked WHERE chunk_id % 7 = 0 AND chunk_id % 4 <> 0")
def annotation_mismatches(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.annotation_mismatches(r.where("chunk_id % 7 != 0 or chunk_id % 4 = 0"), r.where("chunk_id % 4 != 0"))


@query(with_sql(RANKED) + "SELECT query, count(*) AS rows, count(*) FILTER (label = second) AS same, round(count(*) FILTER (label = second) / count(*), 4) AS agreement FROM ranked GROUP BY 1")
def annotator_agreement(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.annotator_agreement(r.withColumn("annotator", F.lit("Ann")), r.withColumn("label", F.col("second")).withColumn("annotator", F.lit("bob")))


@query(with_sql(RANKED) + "SELECT a AS label_a, b AS label_b, (SELECT count(*) FROM ranked WHERE label = a AND second = b) AS n FROM (SELECT unnest(['relevant', 'partially_relevant', 'not_relevant']) AS a), (SELECT unnest(['relevant', 'partially_relevant', 'not_relevant']) AS b)")
def confusion_matrix(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.confusion(r, r.withColumn("label", F.col("second")))


@query(with_sql(RANKED) + "SELECT n, round(same / n, 4) AS agreement, round((same * n - chance) / (n * n - chance), 4) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (label = second) AS same, (SELECT sum(x * y) FROM (SELECT label, count(*) AS x FROM ranked GROUP BY 1) JOIN (SELECT second AS label, count(*) AS y FROM ranked GROUP BY 1) USING (label)) AS chance FROM ranked)")
def cohens_kappa(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.cohens_kappa(evaluate.confusion(r, r.withColumn("label", F.col("second"))))


@query(with_sql(RANKED) + "SELECT *, CASE WHEN after > before THEN 'improved' WHEN after < before THEN 'worse' ELSE 'same' END AS effect FROM (SELECT query, round(count(*) FILTER (second = 'relevant') / count(*), 4) AS before, round(count(*) FILTER (label = 'relevant') / count(*), 4) AS after FROM ranked GROUP BY 1)")
def suggestion_effect(spark, sf):
    r = _ranked(spark, sf)
    return evaluate.suggestion_effect(evaluate.precision_per_query(r.drop("label"), r.withColumn("label", F.col("second"))), evaluate.precision_per_query(r.drop("label"), r))


def _records(spark, sf):
    p = F.col("page_id")
    return D.table(spark, sf, "pages").select(p.alias("seq"), F.format_string("N%05d", p - F.when(p % 10 == 0, p % 20).otherwise(0)).alias("case_number"), F.when(p % 13 != 0, "114.01.01").alias("decision_date"), F.lit("t").alias("dispute_type"), F.col("url").alias("pdf_url"), F.when(p % 17 == 0, "  ").otherwise("dir").alias("case_directory"), F.when(p % 19 == 0, "partial").otherwise("ok").alias("batch_status"))


@query(
    """WITH r AS (SELECT page_id AS seq, page_id - CASE WHEN page_id % 10 = 0 THEN page_id % 20 ELSE 0 END AS number, * FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY seq) AS rn FROM r)
 SELECT seq, 'duplicate_case_number' AS violation FROM n WHERE rn > 1 UNION ALL SELECT seq, 'missing_decision_date' FROM n WHERE seq % 13 = 0 UNION ALL SELECT seq, 'missing_case_directory' FROM n WHERE seq % 17 = 0
 UNION ALL SELECT seq, 'url_prefix' FROM n WHERE NOT starts_with(url, 'https://') UNION ALL SELECT seq, 'unresolved_batch' FROM n WHERE seq % 19 = 0"""
)
def metadata_audit(spark, sf):
    return quality.metadata_audit(_records(spark, sf), "https://")


@query("SELECT (SELECT CAST(sum(o_custkey % 5) AS BIGINT) FROM orders WHERE o_orderstatus IN ('O', 'F')) AS expected, count(*) AS raw, count(DISTINCT l_partkey) AS unique, count(*) - count(DISTINCT l_partkey) AS duplicates, count(*) = (SELECT sum(o_custkey % 5) FROM orders WHERE o_orderstatus IN ('O', 'F')) AS reconciled FROM lineitem")
def batch_reconcile(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "partial").otherwise("failed")
    batches = D.table(spark, sf, "orders").select(status.alias("status"), (F.col("o_custkey") % 5).alias("reported"))
    return quality.batch_reconcile(batches, D.table(spark, sf, "lineitem").select("l_partkey"), "l_partkey")


@query(with_sql(D.QUERIES) + "SELECT query_id, (SELECT count(*) FROM documents WHERE contains(lower(text), lower(query)) OR contains(lower(source), lower(query))) AS n FROM queries")
def keyword_hit_counts(spark, sf):
    return quality.keyword_hit_counts(D.table(spark, sf, "documents"), D.queries(spark, sf), ["text", "source"])


@query(
    with_sql(D.CASES, D.CHUNKS)
    + """SELECT 'count_cases' AS "check", (SELECT count(*) FROM cases) AS actual, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM cases) = (SELECT count(*) FROM documents) AS passed
 UNION ALL SELECT 'cases_without_chunks', n, 0, n = 0 FROM (SELECT count(*) AS n FROM cases WHERE case_id NOT IN (SELECT case_id FROM chunks))
 UNION ALL SELECT 'chunks_without_vectors', n, 0, n = 0 FROM (SELECT count(*) AS n FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE dispute_type < 8)) UNION ALL SELECT 'shortest_chunk', n, 1, n >= 1 FROM (SELECT min(len(vector)) AS n FROM chunks)
 UNION ALL SELECT 'kinds_of_dims', n, 1, n = 1 FROM (SELECT count(DISTINCT len(vector)) AS n FROM chunks WHERE dispute_type < 8)"""
)
def corpus_verify(spark, sf):
    c, k = D.cases(spark, sf), D.chunks(spark, sf).withColumn("chunk_chars", F.size("vector"))
    # vectors exist for the labels below 8, so that some chunks lack theirs
    vectors = k.where("dispute_type < 8").select("chunk_id", F.size("vector").alias("dims"))
    return quality.corpus_verify({"cases": (c, D.table(spark, sf, "documents").count())}, c, k, vectors)


@query(with_sql(D.CHUNKS) + "SELECT chunk_id, 'token_count' AS violation FROM chunks WHERE chunk_id % 10 = 1 UNION ALL SELECT chunk_id, 'norm' FROM chunks WHERE chunk_id % 10 = 2 UNION ALL SELECT chunk_id, 'dims' FROM chunks WHERE chunk_id % 10 = 3 UNION ALL SELECT chunk_id, 'non_finite' FROM chunks WHERE chunk_id % 10 = 4")
def validate_embeddings(spark, sf):
    k, i = D.chunks(spark, sf), F.col("chunk_id") % 10
    dims = k.select(F.size("vector")).first()[0]
    spoilt = F.when(i == 3, F.slice("vector", 2, 1000)).when(i == 4, F.concat(F.slice("vector", 2, 1000), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("vector"))
    return embed.validate_embeddings(k.select("chunk_id", spoilt.alias("vector"), F.when(i == 2, float("inf")).otherwise(1.0).alias("norm"), F.when(i == 1, -1).otherwise(3).alias("token_count")), "chunk_id", dims)
