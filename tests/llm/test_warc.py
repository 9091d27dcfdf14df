import base64
import hashlib

import pytest

from caselake.llm import warc
from caselake.llm.common import get_file, put_file, shared_folder


def expected(rows, least=0):
    groups = {}
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids) if len(data) >= least and len(groups[data]) > 1 and ids else None
        revisit = top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, least=0):
    df = spark.createDataFrame([(*r, "u", "d") for r in rows], "page_id long, html string, url string, digest string")
    return sorted(map(tuple, warc.round_trip(df, shared_folder(spark, "t"), min_bytes=least).collect()), key=str)


def test_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    rows += [(i + 10_000, h) for i, h in rows[::3]]
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, ""), (4, "é\r\n\r\n--- x"), (5, "é\r\n\r\n--- x"), (5, "é\r\n\r\n--- x"), (None, "only"), (None, "é\r\n\r\n--- x"), (7, "<p>" * 400_000), (8, "short"), (9, "short")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, 6) == expected(rows, 6)
    assert run(spark, []) == []


def test_file_is_self_contained_and_records_are_single_frames():
    made = [warc.record(str(i), f"<html>page {i} with the same words again and again</html>".encode() * 3, "D", None) for i in range(200)]
    data = warc.archive(made)
    assert int.from_bytes(data[:4], "little") == warc.MAGIC
    got = list(warc.records(data))
    assert [f["WARC-Type"] for f, _ in got] == ["warcinfo"] + ["response"] * 200
    assert got[7][1].endswith(b"\r\n\r\n" + b"<html>page 6 with the same words again and again</html>" * 3)
    assert len(data) < sum(map(len, made)) / 2
    with pytest.raises(Exception):
        list(warc.records(data[:-3]))


def test_only_written_files_are_read_and_counted(spark):
    rows = [(i, f"page {i % 90} " * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    folder = shared_folder(spark, "t")
    put_file(folder, "part-0000000000-000099.warc.zst", warc.archive([warc.record("777", b"left over", warc.digest32(b"left over"), None)]))
    assert sorted(map(tuple, warc.round_trip(df, folder).collect()), key=str) == expected(rows)
    made = spark.createDataFrame([("part-0000000000-000099.warc.zst", 2, len(get_file(folder, "part-0000000000-000099.warc.zst")))], "name string, n_records long, n_bytes long")
    with pytest.raises(Exception, match="holds 1 records"):
        warc.read(made, folder).collect()


def test_files_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"page {i} " * 40) for i in range(300)]
    made = []
    for given in (rows, rows[::-1]):
        folder = shared_folder(spark, "t")
        files = warc.write(spark.createDataFrame(given, "page_id long, html string").coalesce(1), folder, file_bytes=8000, date="2024-01-01T00:00:00Z").collect()
        made.append(sorted((f["name"], f["n_records"], get_file(folder, f["name"])) for f in files))
    assert len(made[0]) > 4 and made[0] == made[1]


def test_records_are_complete(spark):
    """Addresses, dates, types and ids of the records; an id for each, and revisits that name a response."""
    rows = [(1, "<p>one</p>", "http://a.org/1"), (2, "<p>one</p>", "http://a.org/2 x\r\n"), (3, "<p>two</p>", None), (3, "<p>two</p>", "http://a.org/3"), (4, "<p>two</p>", "http://a.org/4")]
    folder = shared_folder(spark, "t")
    files = warc.write(spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1), folder, date="2024-05-06T07:08:09Z").collect()
    got = [r for f in files for r in warc.records(get_file(folder, f["name"])) if r[0]["WARC-Type"] != "warcinfo"]
    assert len({f["WARC-Record-ID"] for f, _ in got}) == 5 == len(got)
    assert all(f["WARC-Date"] == "2024-05-06T07:08:09Z" and f["Content-Type"] == "application/http; msgtype=response" for f, _ in got)
    assert sorted(f["WARC-Target-URI"] for f, _ in got) == ["http://a.org/1", "http://a.org/2%20x%0D%0A", "http://a.org/3", "http://a.org/4", "urn:page:3"]
    responses = {f["WARC-Record-ID"] for f, _ in got if f["WARC-Type"] == "response"}
    assert len(responses) == 2 and {f["WARC-Refers-To"] for f, _ in got if f["WARC-Type"] == "revisit"} == responses
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") and (f["WARC-Type"] == "revisit") == b.endswith(b"\r\n\r\n") for f, b in got)
    assert int(files[0]["n_records"]) == 5


def test_digests_in_the_jvm(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "é", "x" * 100_000, *(f"page {i}" for i in range(60))])]
    hashed = warc.hashed(spark.createDataFrame(rows, "page_id long, html string"), "page_id", "html")
    got = hashed.withColumn("digest", warc.base32(hashed.sha1)).collect()
    assert [r.digest for r in sorted(got)] == [warc.digest32((t or "").encode()) for _, t in rows]


def test_hot_payloads_are_joined_from_tables(spark):
    """Both sides of the join with a payload's original are scans that are shuffled as they are, and payloads aren't read again."""
    rows = [(k, "" if k % 3 else f"page {k}") for k in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows, "page_id long, html string")
        plan = warc.write(df, shared_folder(spark, "t"))._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("sha1(") == 1
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
