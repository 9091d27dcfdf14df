import pytest
from pyspark.sql import functions as F

from caselake.operators import cases as C
from caselake.sources import stored
from caselake.sources.shared import shared_folder
from caselake.streaming.ingest import ingest_stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def people(spark, pairs, at):
    return spark.createDataFrame([(k, v, at) for k, v in pairs], "k long, v string, created_at string")


@pytest.fixture()
def path(spark):
    p = shared_folder(spark, "stored-test")
    stored.create(people(spark, [(k, str(k)) for k in range(100)] + [(None, "n")], "then"), p, "k", 8)
    return p


def test_merges_equal_the_plain_upsert_and_old_versions_stay(spark, path):
    old = stored.read(spark, path)
    first = rows(old)
    new = people(spark, [(3, None), (5, "five"), (300, "x"), (None, "m")], "now").withColumn("more", F.lit(1))
    wanted = rows(C.upsert(old, new, "k"))
    stored.merge(new, path)
    assert rows(stored.read(spark, path)) == wanted and (3, None, "then") in wanted and (300, "x", "now") in wanted
    assert rows(stored.read(spark, path, 0)) == first
    stored.merge(new.limit(0), path)
    assert rows(stored.read(spark, path)) == wanted and stored.latest(spark, path).version == 2
    stored.replace(people(spark, [(7, "a"), (7, "b")], "now"), spark.createDataFrame([(7,), (8,), (9,)], "k long"), path)
    assert rows(stored.read(spark, path)) == sorted([r for r in wanted if r[0] not in (7, 8, 9)] + [(7, "a", "now"), (7, "b", "now")], key=repr)
    now = rows(stored.read(spark, path))
    assert stored.vacuum(spark, path) and not stored.vacuum(spark, path)
    assert rows(stored.read(spark, path)) == now
    with pytest.raises(ValueError):
        stored.read(spark, path, 0)


def test_only_touched_buckets_are_read_and_written_and_the_stored_side_is_not_shuffled(spark, path):
    before = set(stored.latest(spark, path).pieces)
    new = people(spark, [(3, "three")], "now")
    at = stored.latest(spark, path)
    touched = stored._touched(new, at)
    live = stored._live(at, touched)
    assert len(touched) == len(live) == 1
    plan = C.upsert(stored._pieces(spark, path, at, live), new, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the batch's
    assert "SelectedBucketsCount: 8 out of 8" in plan and f"PartitionFilters: [isnotnull({stored.PIECE}" in plan
    stored.merge(new, path)
    after = set(stored.latest(spark, path).pieces)
    assert len(before & after) == 7 and len(after) == 8


def test_an_interrupted_merge_leaves_the_old_version(spark, path, monkeypatch):
    first = rows(stored.read(spark, path))
    new = people(spark, [(3, "three"), (400, "y")], "now")
    with pytest.raises(Exception, match="cut off"):  # a task fails
        stored.merge(new.withColumn("v", F.when(F.col("k") == 400, F.raise_error(F.lit("cut off"))).otherwise(F.col("v"))), path)
    assert rows(stored.read(spark, path)) == first
    with monkeypatch.context() as m:  # the driver is lost when the pieces are written
        m.setattr(stored, "_publish", lambda *_: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            stored.merge(new, path)
    assert rows(stored.read(spark, path)) == first and stored.latest(spark, path).version == 0
    assert stored.vacuum(spark, path)  # the pieces that belong to no version
    wanted = rows(C.upsert(stored.read(spark, path), new, "k"))
    stored.merge(new, path)
    assert rows(stored.read(spark, path)) == wanted


def test_a_second_writer_of_a_version_fails(spark, path):
    at = stored.latest(spark, path)
    stored.merge(people(spark, [(1, "a")], "now"), path)
    with pytest.raises(Exception, match="already exists"):
        stored._commit(people(spark, [(2, "b")], "now"), path, at, [0], -1)


def test_empty_table_clashing_names_and_repeated_batches(spark):
    p = shared_folder(spark, "stored-empty")
    none = people(spark, [(1, "a")], "then").limit(0)
    stored.create(none, p, "k", 4)
    assert rows(stored.read(spark, p)) == []
    stored.merge(people(spark, [(1, "a")], "now"), p, batch=0)
    stored.merge(people(spark, [(1, "b")], "now"), p, batch=0)
    assert rows(stored.read(spark, p)) == [(1, "a", "now")]
    with pytest.raises(ValueError):
        stored.create(none.withColumn(stored.PIECE, F.lit("x")), p + "-2", "k")
    with pytest.raises(Exception, match="created_at"):
        stored.merge(none.drop("created_at"), p)


def test_a_stream_is_merged_once(spark, path):
    source = shared_folder(spark, "stream-in")
    people(spark, [(5, "b"), (5, "a"), (500, "z")], "now").coalesce(1).write.parquet(source)
    check = shared_folder(spark, "stream-check")
    stream = lambda: ingest_stored(spark.readStream.schema("k long, v string, created_at string").parquet(source), path, "k", "v", check).awaitTermination()
    stream()
    got = rows(stored.read(spark, path))
    assert (5, "a", "then") in got and (500, "z", "now") in got and len(got) == 102
    at = stored.latest(spark, path)
    stored.merge(people(spark, [(5, "late")], "now"), path, batch=at.batch)
    assert rows(stored.read(spark, path)) == got
