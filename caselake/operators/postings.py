"""Full-text search by BM25: term counts of documents, and a stored inverted index of them.

The index (Postings) has a row for each term and segment of the corpus: the documents of the segment (SEGMENT_DOCS, dealt by hash)
that hold the term, how often, and their lengths, as arrays, with the segment's greatest count and least length. A common
term is as many rows as there are segments. The table is partitioned by bucket of term, so a batch of queries reads its own terms'
buckets alone.

A query takes only segments in which all its terms occur, which the rows' narrow columns tell, and in them begins with the
rarest term. With a limit it looks first at the segments that promise most, then only at those whose promise, the sum of the
terms' greatest weights there, reaches the last of the results found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_folder, written

K1, B = 1.2, 0.75
SEGMENT_DOCS = 16_384
#: Queries that look at a segment together, postings in a bucket, and most buckets.
TOGETHER, BUCKET_ROWS, BUCKETS = 64, 4_000_000, 256
#: Terms that Spark looks for itself, so that only these leave it; of more of them, all of a text's terms do.
IN_PLACE = 4096
#: Terms of a batch that are counted together, whatever the size of Spark's batches.
COUNTED = 65_536
#: Segments that a query with a limit looks at first.
FIRST = 2


def term_rows(batch: pa.RecordBatch, known: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """(key, term, tf, length) of a batch of (key, terms, length), made from at most COUNTED terms at a time, or from one longer text."""
    terms, ends, start = batch.column(1).flatten(), batch.column(1).offsets.to_numpy().astype(np.int64), 0
    ends -= ends[0]
    if known is not None:
        keep = pc.is_in(terms, value_set=known)
        terms, ends = terms.filter(keep), np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[ends]
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNTED, "right")) - 1)
        part, own, n = batch.slice(start, stop - start), ends[start : stop + 1], stop - start
        coded, row, length = terms.slice(own[0], own[-1] - own[0]).dictionary_encode(), np.repeat(np.arange(n), np.diff(own)), part.column(2).to_numpy()
        width = max(1, len(coded.dictionary))
        cell, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(cell, width)
        row = np.concatenate([row, np.arange(n)])
        none = pa.nulls(n, pa.string())
        term = pa.concat_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), none])
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), term, pa.array(np.concatenate([tf, np.zeros(n, np.int64)])), pa.array(length[row])], names=[batch.schema.names[0], "term", "tf", "length"])
        start = stop


def counted(docs: DataFrame, key: str, columns: list[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length) for each distinct term of a document (of the vocabulary, a column `term`, if given), and a row without a
    term for every document. Terms are cut by Spark and counted where they are, so no row is made for a token."""
    terms = F.concat(*(T.search_terms(F.col(c).cast("string")) for c in columns))
    known, kept = None, lambda t: t
    if vocabulary is not None:
        some = vocabulary.limit(IN_PLACE + 1).toArrow()["term"].combine_chunks()
        if len(some) <= IN_PLACE:
            kept = lambda t: F.filter(t, lambda x: x.isin(some.to_pylist()))
        else:
            known = docs.sparkSession.sparkContext.broadcast(vocabulary.toArrow()["term"].combine_chunks())
    # as an array's element, so that the terms are cut once for both
    both = F.transform(F.array(terms), lambda t: F.struct(kept(t).alias("terms"), F.size(t).cast("long").alias("length")))
    rows = docs.select(key, F.get(both, 0).alias("b")).select(key, "b.terms", "b.length")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from term_rows(batch, known.value if known is not None else None)

    return rows.mapInArrow(batches, f"`{key}` {rows.schema[key].dataType.simpleString()}, term string, tf long, length long")


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of the queries' distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(T.search_terms(F.col("query")))).alias("term"))


def rarity(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def weight(idf: Column, tf: Column, length: Column, avgdl: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avgdl or 1.0)))


def bm25(docs: DataFrame, queries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(query_id, key, score) of documents with every term of the query, from one pass over the texts that keeps the queries' terms alone.

    A term's rarity counts over all documents. What a common term is joined with is a table, so that Spark can split it.
    """
    wanted = written(wanted_terms(queries), "wanted-terms")
    found = written(counted(docs, key, columns, wanted.select("term").distinct()), "counted-terms")
    n, avgdl = found.where("term is null").agg(F.count(F.lit(1)), F.avg("length")).first()
    dfs = found.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    need = Window.partitionBy("query_id")
    asked = written(wanted.withColumn("need", F.count(F.lit(1)).over(need)).join(dfs, "term").select("query_id", "term", "need", rarity(F.lit(n), F.col("df")).alias("idf")), "asked-terms")
    each = found.where("term is not null").join(asked, "term").withColumn("w", weight(F.col("idf"), F.col("tf"), F.col("length"), avgdl))
    scored = each.groupBy("query_id", key).agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("have"), F.max("need").alias("need"))
    return scored.where("have = need").select("query_id", key, "score")


@dataclass(frozen=True)
class Postings:
    """(bucket, term, segment, n, most, least, keys, tfs, lengths) of every term, and the corpus's totals."""

    table: DataFrame
    key: str
    docs: int
    avgdl: float
    segments: int
    buckets: int

    def search(self, queries: DataFrame, limit: int | None = None, decimals: int = 9) -> DataFrame:
        """(query_id, key, score) of documents with every term of the query; with a limit, of each query at least those whose score,
        rounded to `decimals`, is among its first `limit`."""
        wanted = wanted_terms(queries).withColumn("bucket", bucket(F.col("term"), self.buckets))
        wanted = written(wanted.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "wanted-terms")
        read = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS values
        rows = self.table.where(F.col("bucket").isin(read))
        narrow = rows.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "segment", "n", "most", "least")
        dfs = narrow.groupBy("term").agg(F.sum("n").alias("df")).select("term", rarity(F.lit(self.docs), F.col("df")).alias("idf"))
        asked = written(wanted.join(dfs, "term").select("query_id", "term", "need", "idf"), "asked-terms")
        promise = weight(F.col("idf"), F.col("most"), F.col("least"), self.avgdl)
        live = asked.join(narrow, "term").groupBy("query_id", "segment").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("need"), F.sum(promise).alias("promise")).where("have = need")
        live = written(live.select("query_id", "segment", "promise", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("promise"), "segment")).alias("place")), "segments")
        if limit is None:
            return self._scored(rows, live, asked)
        first = written(self._scored(rows, live.where(F.col("place") <= FIRST), asked), "first-scores")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        floors = first.withColumn("k", place).where(F.col("k") == limit).select("query_id", F.col("score").alias("floor"))
        more = live.where(F.col("place") > FIRST).join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("promise") >= F.col("floor") - 2 * 10.0**-decimals))
        return first.unionByName(self._scored(rows, more, asked))

    def _scored(self, rows: DataFrame, live: DataFrame, asked: DataFrame) -> DataFrame:
        """Each segment's wanted rows are read once for TOGETHER queries or so."""
        together = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.select("query_id").distinct().count() // TOGETHER)))).alias("of")
        each = written(live.select("query_id", "segment").join(asked, "query_id").select(together, "segment", "query_id", "term", "idf"), "asked-segments")
        arrays = F.struct("term", "keys", "tfs", "lengths")
        held = rows.join(each.select("of", "segment", "term").distinct(), ["term", "segment"]).groupBy("of", "segment").agg(F.collect_list(arrays).alias("held"))
        asks = each.groupBy("of", "segment").agg(F.collect_list(F.struct("query_id", "term", "idf")).alias("asks"))
        avgdl, key = self.avgdl or 1.0, self.key
        q_type, key_type = live.schema["query_id"].dataType.simpleString(), rows.schema["keys"].dataType.elementType.simpleString()

        def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                kinds = [batch.schema.field("asks").type.value_type.field("query_id").type, batch.schema.field("held").type.value_type.field("keys").type.value_type]
                for i in range(len(batch)):
                    flat = batch.column("held")[i].values
                    part = {name: flat.field(name) for name in ("keys", "tfs", "lengths")}
                    own = {t.as_py(): {name: column[k].values.to_numpy(zero_copy_only=False) for name, column in part.items()} for k, t in enumerate(flat.field("term"))}
                    queries: dict = {}
                    for a in batch.column("asks")[i].as_py():
                        queries.setdefault(a["query_id"], []).append((len(own[a["term"]]["keys"]), a["term"], a["idf"]))
                    for query, terms in queries.items():
                        keys, total = None, None
                        for _, term, idf in sorted(terms):  # the rarest first
                            p = own[term]
                            w = idf * p["tfs"] * (K1 + 1) / (p["tfs"] + K1 * (1 - B + B * p["lengths"] / avgdl))
                            if keys is None:
                                keys, total = p["keys"], w
                            else:
                                keys, a, b = np.intersect1d(keys, p["keys"], assume_unique=True, return_indices=True)
                                total = total[a] + w[b]
                            if not len(keys):
                                break
                        if len(keys):
                            yield pa.RecordBatch.from_arrays([pa.array([query] * len(keys), kinds[0]), pa.array(keys, kinds[1]), pa.array(total)], names=["query_id", key, "score"])

        return held.join(asks, ["of", "segment"]).select("held", "asks").mapInArrow(score, f"query_id {q_type}, `{key}` {key_type}, score double")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def build(docs: DataFrame, key: str, columns: list[str]) -> Postings:
    """The stored index of the documents' columns; keys are distinct."""
    raw = written(counted(docs, key, columns), "term-counts")
    n, avgdl, rows = raw.agg(F.count(F.when(F.col("term").isNull(), 1)), F.avg(F.when(F.col("term").isNull(), F.col("length"))), F.count("term")).first()
    segments, buckets = max(1, -(-n // SEGMENT_DOCS)), max(1, min(BUCKETS, -(-rows // BUCKET_ROWS)))
    segment = F.pmod(F.xxhash64(key), F.lit(segments)).cast("int").alias("segment")
    parts = raw.where("term is not null").select("term", segment, F.struct(F.col(key).alias("key"), "tf", "length").alias("p"), "tf", "length")
    arrays = parts.groupBy("term", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.sort_array(F.collect_list("p")).alias("p"))
    rows_ = arrays.select(bucket(F.col("term"), buckets).alias("bucket"), "term", "segment", "n", "most", "least", F.col("p.key").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"))
    path = shared_folder(docs.sparkSession, "postings")
    rows_.sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").parquet(path)
    table = docs.sparkSession.read.schema(rows_.schema).parquet(path)
    return Postings(table, key, n, avgdl or 0.0, segments, buckets)
