import pyarrow as pa

from caselake.operators import sections
from caselake.plans import bindings, registry, texts


def test_tables_leave_for_python_in_small_batches(spark, tmp_path):
    """Of a partition of 30 MB no more than a few are with a worker at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(60).selectExpr("id as doc_id", "repeat(cast(id % 10 as string), 500000) as text")
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    found = [r.n for r in bindings.table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 6_000_000
    assert registry.QUERIES["sentence_split"](spark, str(tmp_path)).count() == 0


def workers(df) -> int:
    """Python nodes of a plan, each of which is a worker for every task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(node) for node in ("ArrowEvalPython [", "MapInArrow ", "MapInPandas "))


def test_texts_are_cut_by_one_worker_a_task(spark, sf):
    """Sections were cut twice, once to see whether there are any, and packets by a third worker."""
    for name in ("split_sections", "split_exact_packets"):
        assert workers(registry.QUERIES[name](spark, sf)) == 1, name


def test_packets_of_documents_are_those_of_their_sections(spark, sf):
    docs = bindings.table(spark, sf, "documents")
    cut = sections.split_sections(docs, "text", ["doc_id"], texts.LATIN_SECTIONS)
    made = sections.document_packets(docs, "text", ["doc_id"], texts.LATIN_SECTIONS, ("holding",))
    order = ["doc_id", "section_id", "part_index"]
    want = sections.split_packets(cut, ["doc_id"], texts.LATIN_SECTIONS).orderBy(*order).collect()
    assert want and made.where("part_index > 0").orderBy(*order).collect() == want
    whole = cut.where("section_type = 'holding'").select("doc_id", "section_id", "start_offset", "end_offset", "content").orderBy("doc_id", "section_id").collect()
    got = made.where("part_index = 0").select("doc_id", "section_id", "start_offset", "end_offset", "text").orderBy("doc_id", "section_id").collect()
    assert whole and [tuple(r) for r in got] == [tuple(r) for r in whole]


def test_a_summary_cuts_its_texts_once(spark, sf):
    """Sentences of parties, overlaps and shown items each need a worker; sections and packets were cut anew by each of their readers."""
    assert workers(registry.QUERIES["extractive_summary"](spark, sf)) == 3
