"""Dot products of a batch of queries with a corpus of vectors that stays where it is, and a clustered layout that lets most of it unread.

Queries travel, the corpus doesn't: they are cut into blocks of QUERY_BYTES at most, each of which is broadcast and
meets every Arrow batch of the corpus in the task that reads it. A task keeps each query's first results so far in the final
order, ties included, so however many vectors are alike it gives back `best` rows for a query, and what is shuffled is
tasks x queries x best rows. More blocks of queries mean more passes over the corpus, not more memory.

The layout (ClusterIndex) stores the vectors by their nearest centroid, with the greatest distance from it, r. No vector x of a
cluster scores higher than q.x = q.c + q.(x - c) <= q.c + |q| r. A query looks first at the cluster that lies nearest, which gives a
score that its last result has at least; then only at clusters whose bound reaches that. So results are those of the
whole scan. Centroids come from a bounded sample; every vector is stored.

Rankings (first_of_each, whole_rankings) take the other way: the items are stored once in the order that decides between equal
scores (Ordered), the queries are dealt out, and a task reads the stored items batch by batch for a block of its queries. So a query's
ranking is made where it is given out; neither scores nor ranks are shuffled, and a block is as large as a task may hold rankings.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written

#: Of the queries, what is broadcast at once.
QUERY_BYTES = 64 << 20
#: Scores that a task holds at once, and the most candidates before it sorts them.
CELLS = 1 << 19
HELD = 1 << 17
#: Most clusters of a layout, and vectors for each of them that their centroids are fitted on.
CLUSTERS, SAMPLE = 256, 48
#: Of stored items, rows that are read at once; queries that meet them together at most, and bytes of whole rankings that a task holds.
ROWS, BLOCK = 4096, 256
RANKED_BYTES = 64 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of 64-bit floats."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rounded(x: np.ndarray, decimals: int | None) -> np.ndarray:
    """As Spark rounds: half up, by the decimal form."""
    if decimals is None:
        return x
    scaled = np.abs(x) * 10.0**decimals
    out = np.round(x, decimals)
    unit = decimal.Decimal(1).scaleb(-decimals)
    for k in np.flatnonzero(np.abs(scaled - np.trunc(scaled) - 0.5) < 1e-6).tolist():
        out[k] = float(decimal.Decimal(repr(float(x[k]))).quantize(unit, decimal.ROUND_HALF_UP))
    return out


def ranks(column: pa.ChunkedArray | pa.Array, ascending: bool) -> np.ndarray:
    """Places of a column's values, equal ones alike; nulls are first in ascending and last in descending order, as in Spark."""
    options = dict(sort_keys="ascending" if ascending else "descending", null_placement="at_start" if ascending else "at_end", tiebreaker="dense")
    return pc.rank(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, **options).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Wanted:
    """What is kept of a query's scores: those above `least`; of each group the best item (the least id of equals); the first `best`
    by rounded score, then by `ties` (column, ascending)."""

    best: int | None = None
    least: float | None = None
    decimals: int | None = None
    group: bool = False
    ties: tuple[tuple[str, bool], ...] = ()


class Top:
    """The first results of each of n queries among what has been added."""

    def __init__(self, n: int, wanted: Wanted):
        self.wanted, self.held, self.rows = wanted, [], 0
        self.floor = np.full(n, -np.inf)

    def add(self, rows: pa.Table, query: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        self.held.append(rows.append_column("_q", pa.array(query)).append_column("_s", pa.array(score)))
        self.rows += len(query)
        if self.rows > HELD:
            self.sort()

    def sort(self) -> None:
        if not self.held:
            return
        t, w = pa.concat_tables(self.held), self.wanted
        query, score = t["_q"].to_numpy(), t["_s"].to_numpy()
        if w.group:
            group, item = ranks(t["g"], True), ranks(t["id"], True)
            order = np.lexsort((item, -score, group, query))
            first = np.append(True, (query[order][1:] != query[order][:-1]) | (group[order][1:] != group[order][:-1]))
            t = t.take(pa.array(order[first]))
            query, score = t["_q"].to_numpy(), t["_s"].to_numpy()
        shown = rounded(score, w.decimals)
        order = np.lexsort((*(ranks(t[c], up) for c, up in reversed(w.ties)), -shown, query))
        query, shown = query[order], shown[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        last = place == w.best - 1
        self.floor[query[last]] = shown[last] - (0 if w.decimals is None else 10.0**-w.decimals)
        self.held = [t.take(pa.array(order[place < w.best]))]
        self.rows = len(self.held[0])


def _met(q: np.ndarray, rows: pa.Table, x: np.ndarray, wanted: Wanted, top: Top | None, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries `of` against a batch: (query, row, score) of what is given out now; what `top` keeps is added to it."""
    step = max(1, CELLS // max(1, len(x)))
    if wanted.group and top is None:
        group, item = ranks(rows["g"], True), ranks(rows["id"], True)
        order = np.lexsort((item, group))
        first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        ends = np.append(first[1:], len(order))
    for i in range(0, len(of), step):
        own = of[i : i + step]
        score = q[own] @ x.T
        keep = np.ones(score.shape, bool) if wanted.least is None else score > wanted.least
        if top is not None:
            a, b = np.nonzero(keep & (score >= top.floor[own][:, None]))
            top.add(rows.take(pa.array(b)), own[a], score[a, b])
        elif wanted.group:
            ordered = np.where(keep, score, -np.inf)[:, order]
            best = np.maximum.reduceat(ordered, first, axis=1)
            hit = ordered == np.repeat(best, ends - first, axis=1)
            a, g = np.nonzero(np.isfinite(best))
            # of a group's equals the first, which has the least id
            at = np.array([first[k] + int(hit[r, first[k] : ends[k]].argmax()) for r, k in zip(a.tolist(), g.tolist(), strict=True)], np.int64)
            yield own[a], order[at], best[a, g]
        else:
            a, b = np.nonzero(keep)
            yield own[a], b, score[a, b]


def query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the queries, QUERY_BYTES at a time."""
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    rows = written(rows, "query-vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // QUERY_BYTES))
    for b in range(blocks):
        part = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        if len(part):
            yield part["k"].combine_chunks(), matrix(part["v"].combine_chunks())


def _scan(items: DataFrame, keys: pa.Array, q: np.ndarray, wanted: Wanted, q_type: str, needs: np.ndarray | None = None) -> DataFrame:
    """(query_id, item_id, score) of a block of queries against items (id, g, ties, vector, and cluster where `needs` says which queries need which)."""
    sent = items.sparkSession.sparkContext.broadcast((keys, q, needs))
    id_type = items.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, needs = sent.value
        top = Top(len(q), wanted) if wanted.best is not None else None
        everyone = np.arange(len(q))

        def out(ids, query, score):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "item_id", "score"])

        for batch in it:
            if not len(batch):
                continue
            whole = pa.Table.from_batches([batch])
            cluster = None if needs is None else whole["cluster"].to_numpy()
            for c in [None] if needs is None else np.unique(cluster).tolist():
                of = everyone if c is None else np.flatnonzero(needs[:, c])
                if not len(of):
                    continue
                part = (whole if c is None else whole.filter(pa.array(cluster == c))).combine_chunks()
                x = matrix(part["vector"].combine_chunks())
                rows = part.drop_columns(["vector"])
                for query, row, score in _met(q, rows, x, wanted, top, of):
                    yield out(rows["id"].combine_chunks().take(pa.array(row)), query, score)
        if top is not None:
            top.sort()
            for t in top.held:
                yield out(t["id"].combine_chunks(), t["_q"].to_numpy(), t["_s"].to_numpy())

    return items.mapInArrow(batches, f"query_id {q_type}, item_id {id_type}, score double")


def _items(items: DataFrame, item_key: str, vector: str, group: str | None, ties: tuple[tuple[str, bool], ...]) -> DataFrame:
    more = [F.col(c) for c, _ in ties if c not in ("id", "g")]
    return items.where(F.col(vector).isNotNull()).select(F.col(item_key).alias("id"), *([F.col(group).alias("g")] if group else []), *more, F.col(vector).alias("vector"))


def _united(parts: list[DataFrame], items: DataFrame, q_type: str, id_type: str) -> DataFrame:
    if not parts:
        return items.sparkSession.createDataFrame([], f"query_id {q_type}, item_id {id_type}, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dot_products(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str = "vector", best: int | None = None, least: float | None = None, decimals: int | None = None, group: str | None = None, ties: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    """(query_id, item_id, score) of every query against every item; the items are scanned where they lie.

    `least` drops scores that aren't above it before rounding; `group` keeps a query's best item of each group; `best` keeps,
    in each task, the first so many by rounded score and `ties`, columns of the items ("id" and "g" are key and group). Without
    `best`, a group has a row for each batch that it occurs in.
    """
    wanted = Wanted(best, least, decimals, group is not None, tuple(ties) or (("id", True),))
    rows = _items(items, item_key, vector, group, wanted.ties)
    q_type = queries.schema[query_key].dataType.simpleString()
    parts = [_scan(rows, keys, q, wanted, q_type) for keys, q in query_blocks(queries, query_key, vector)]
    return _united(parts, items, q_type, rows.schema["id"].dataType.simpleString())


@dataclass(frozen=True)
class Ordered:
    """Items (id, g, vector) in files that follow one another in the order of equal scores; n of them, in so many groups."""

    files: list[str]
    n: int
    groups: int
    id_type: str
    g_type: str | None

    def read(self) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """The items without their vectors but with their places, and the vectors, ROWS at a time."""
        n = 0
        for uri in self.files:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=ROWS):
                    if len(batch):
                        rows = pa.Table.from_batches([batch])
                        x = matrix(rows["vector"].combine_chunks())
                        yield rows.drop_columns(["vector"]).append_column("place", pa.array(np.arange(n, n + len(batch)))), x
                        n += len(batch)


def ordered(items: DataFrame, item_key: str, order: list[Column], vector: str = "vector", group: str | None = None) -> Ordered:
    """The items stored in an order; for whole_rankings a group's items have to follow one another in it, the least id first."""
    g = [F.col(group).alias("g")] if group else []
    rows = items.where(F.col(vector).isNotNull()).orderBy(*order).select(F.col(item_key).alias("id"), *g, F.col(vector).alias("vector"))
    stored = written(rows, "ordered")
    n, groups = stored.agg(F.count(F.lit(1)), F.countDistinct("g") if group else F.lit(0)).first()
    kind = lambda c: stored.schema[c].dataType.simpleString()
    files = sorted(stored.inputFiles(), key=lambda f: f.rsplit("/", 1)[1])
    return Ordered(files, n, groups, kind("id"), kind("g") if group else None)


def _dealt(queries: DataFrame, key: str, vector: str, together: int) -> DataFrame:
    """(k, v) of the queries, dealt out to at least as many tasks as run at once, `together` or fewer to each."""
    rows = written(queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")), "query-vectors")
    tasks = max(-(-rows.count() // together), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks)


def _blocks(it: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in it:
        for i in range(0, len(batch), together):
            part = batch.slice(i, together)
            yield part.column(0), matrix(part.column(1))


def first_of_each(queries: DataFrame, query_key: str, at: Ordered, best: int, vector: str = "vector", least: float | None = None, decimals: int | None = None) -> DataFrame:
    """(query_id, rank, id, g, score): each query's first `best` items, or the best item of each of its first `best` groups."""
    wanted = Wanted(best, least, decimals, at.g_type is not None, (("place", True),))
    together = max(1, min(BLOCK, HELD // (4 * best)))
    rows = _dealt(queries, query_key, vector, together)
    names = ["id", "g"] if at.g_type else ["id"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, q in _blocks(it, together):
            top, everyone = Top(len(q), wanted), np.arange(len(q))
            for items, x in at.read():
                for _ in _met(q, items, x, wanted, top, everyone):
                    pass
            top.sort()
            for t in top.held:
                query = t["_q"].to_numpy()
                first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
                columns = [keys.take(pa.array(query)), pa.array(rank, pa.int32()), *(t[c].combine_chunks() for c in names), t["_s"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", *names, "score"])

    g = f", g {at.g_type}" if at.g_type else ""
    return rows.mapInArrow(batches, f"query_id {rows.schema['k'].dataType.simpleString()}, rank int, id {at.id_type}{g}, score double")


def _best_of_groups(q: np.ndarray, at: Ordered) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Ids of items and groups, each query's best score in each group, and the place of the item that has it, the first of equals."""
    best, row = np.full((len(q), at.groups), -np.inf), np.zeros((len(q), at.groups), np.int32)
    ids, names, last, n, c = [], [], None, 0, 0
    for items, x in at.read():
        coded = items["g"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        groups = coded.dictionary.take(pa.array(code[first]))
        score = q @ x.T
        top = np.maximum.reduceat(score, first, axis=1)
        hit = np.where(score == np.repeat(top, np.diff(np.append(first, len(x))), axis=1), np.arange(len(x)), len(x) - 1)
        places = np.minimum.reduceat(hit, first, axis=1) + n
        begun = int(last is not None and groups[0].equals(last))  # a group that the batch before has begun
        if begun:
            better = top[:, 0] > best[:, c - 1]
            best[better, c - 1], row[better, c - 1] = top[better, 0], places[better, 0]
        more = len(groups) - begun
        best[:, c : c + more], row[:, c : c + more] = top[:, begun:], places[:, begun:]
        ids.append(items["id"].combine_chunks())
        names.append(groups.slice(begun))
        last, n, c = groups[-1], n + len(x), c + more
    return pa.concat_arrays(ids), pa.concat_arrays(names), best, row


def whole_rankings(queries: DataFrame, query_key: str, at: Ordered, vector: str = "vector", decimals: int | None = 4, fused: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(query_id, g, id, shown, rank) of every group for each query, by its best item's score; `shown` is that score rounded.

    `fused` makes of the shown scores and the places in the order of equals, both in the order of ranks, two more columns: again and fused.
    """
    together = max(1, min(BLOCK, RANKED_BYTES // (12 * max(1, at.groups))))
    rows = _dealt(queries, query_key, vector, together)
    more = ["again", "fused"] if fused else []

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, q in _blocks(it, together) if at.n else ():
            ids, names, best, row = _best_of_groups(q, at)
            rank = pa.array(np.arange(1, len(names) + 1), pa.int32())
            for i, key in enumerate(keys):
                order = np.argsort(-best[i], kind="stable")
                shown = rounded(best[i][order], decimals)
                extra = [pa.array(x) for x in fused(shown, order)] if fused else []
                columns = [pa.repeat(key, len(names)), names.take(pa.array(order)), ids.take(pa.array(row[i][order])), pa.array(shown), rank, *extra]
                yield from pa.Table.from_arrays(columns, names=["query_id", "g", "id", "shown", "rank", *more]).to_batches(max_chunksize=1 << 16)

    extra = ", again int, fused double" if fused else ""
    return rows.mapInArrow(batches, f"query_id {rows.schema['k'].dataType.simpleString()}, g {at.g_type}, id {at.id_type}, shown double, rank int{extra}")


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k means of a sample, begun at points far from each other."""
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < k and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    c = sample[picked].copy()
    for _ in range(rounds):
        of = nearest(sample, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        counts = np.bincount(of, minlength=len(c))
        c[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, and its distance from it."""
    of = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
    return of, np.sqrt(((x - c[of]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class ClusterIndex:
    """Vectors by cluster in a table, and on the driver at most CLUSTERS centroids, radii and counts."""

    path: str
    items: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    #: Called with a dict of figures for each block of queries: pairs of a query and a cluster, and how many of them were skipped.
    report: Callable[[dict], None] | None = None

    def needed(self, q: np.ndarray, floor: np.ndarray, margin: float) -> np.ndarray:
        """Which queries may find a score of at least `floor` in which clusters; rounding errors are allowed for."""
        length = np.sqrt((q * q).sum(axis=1))
        bound = q @ self.centroids.T + length[:, None] * self.radii
        slack = margin + 1e-9 * (1 + np.abs(bound))
        return (bound + slack >= floor[:, None]) & (self.counts > 0)

    def top(self, queries: DataFrame, query_key: str, best: int, vector: str = "vector", least: float | None = None, decimals: int | None = None, grouped: bool = False, ties: tuple[tuple[str, bool], ...] = (("id", True),)) -> DataFrame:
        """(query_id, item_id, score): a superset of each query's first `best`, like dot_products'."""
        wanted = Wanted(best, least, decimals, grouped, tuple(ties))
        q_type = queries.schema[query_key].dataType.simpleString()
        margin = 0.0 if decimals is None else 10.0**-decimals
        parts = []
        for keys, q in query_blocks(queries, query_key, vector):
            first = np.zeros((len(q), len(self.counts)), bool)
            score = np.where(self.counts > 0, q @ self.centroids.T, -np.inf)
            first[np.arange(len(q)), score.argmax(axis=1)] = True
            seen = written(self._read(keys, q, wanted, q_type, first), "probed")
            needs = self.needed(q, self._floors(seen, keys, best, grouped), margin) & ~first
            if self.report:
                self.report({"pairs": int((self.counts > 0).sum()) * len(q), "skipped": int((self.counts > 0).sum()) * len(q) - int(needs.sum()) - len(q), "clusters": int((self.counts > 0).sum()), "unread": int(((self.counts > 0) & ~(needs | first).any(axis=0)).sum())})
            parts.append(seen)
            if needs.any():
                parts.append(self._read(keys, q, wanted, q_type, needs))
        return _united(parts, self.items, q_type, self.items.schema["id"].dataType.simpleString())

    def _read(self, keys: pa.Array, q: np.ndarray, wanted: Wanted, q_type: str, needs: np.ndarray) -> DataFrame:
        clusters = np.flatnonzero(needs.any(axis=0)).tolist()
        return _scan(self.items.where(F.col("cluster").isin(clusters)), keys, q, wanted, q_type, needs)

    def _floors(self, seen: DataFrame, keys: pa.Array, best: int, grouped: bool) -> np.ndarray:
        """The last of a query's first `best` scores as far as seen, a value for each query of the block."""
        if grouped:
            groups = self.items.select(F.col("id").alias("item_id"), "g")
            seen = seen.join(groups, "item_id").groupBy("query_id", "g").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        last = dict(seen.withColumn("place", place).where(F.col("place") == best).select("query_id", "score").collect())
        return np.array([last.get(k, -np.inf) for k in keys.to_pylist()])


def cluster_index(items: DataFrame, item_key: str, vector: str = "vector", group: str | None = None, ties: tuple[tuple[str, bool], ...] = (), clusters: int | None = None, report: Callable[[dict], None] | None = None) -> ClusterIndex:
    """A layout of the items; the only shuffle of the corpus is the one that writes it, by range of cluster and id, so that a large
    cluster has many files."""
    rows = _items(items, item_key, vector, group, tuple(ties))
    spark, names = rows.sparkSession, rows.columns
    n = rows.count()
    k = max(1, min(CLUSTERS, clusters or int(n**0.5)))
    sampled = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(k * SAMPLE).select("vector").toArrow()
    c = centroids(matrix(sampled["vector"].combine_chunks()), k) if n else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(c)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                of, distance = nearest(matrix(batch.column(batch.schema.get_field_index("vector"))), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(distance)], names=[*batch.schema.names, "cluster", "distance"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    assigned = rows.mapInArrow(assign, f"{kinds}, cluster int, distance double")
    path = shared_folder(spark, "clusters")
    assigned.repartitionByRange("cluster", F.xxhash64("id")).write.partitionBy("cluster").parquet(path)
    stored = spark.read.schema(f"{kinds}, distance double, cluster int").parquet(path)
    found = stored.groupBy("cluster").agg(F.max("distance"), F.count(F.lit(1))).collect()
    radii, counts = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for of, radius, number in found:
        radii[of], counts[of] = radius, number
    return ClusterIndex(path, stored.select(*names, "cluster"), c, radii, counts, report)
