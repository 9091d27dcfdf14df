"""A Merkle manifest of a dataset: a tree of runs of eight for each group, a tree over the groups, and a proof for each row.

A row's leaf is SHA-256 over its columns. In a group the leaves ascend by id; while there is more than one node, eight
consecutive ones (at the end fewer, even one) become the digest of their digests' hexadecimal text, up to the group's subroot.
The subroots, ascending by group, make the root in the same way. A leaf's proof is the digests beside it and beside each
node above it, so that who holds the root alone can tell whether a row has changed.

The trees are worked on by time-forward processing. A node is labelled with the last leaf below it and its level, so that
children come before their parents. A priority queue ordered by label delivers digests to parents: a sweep in ascending
order meets a node when all its children have been heard of. A second sweep, in descending order, delivers to each
node what follows on the proofs of all leaves below it, and at last to the leaves. Nothing but the queue is held.

Spark keeps the queue between tasks: messages are rows of a table, sorted by label. A task sweeps over blocks of 8**LEVELS
consecutive nodes; their tops are the nodes of the next round, and the suffixes of their tops come
first among a block's rows on the way back. So the rounds are few (a billion rows have three), no task holds more than
a block, and a group with most of the rows is many blocks. The numbers of a group's leaves come from a sort by range: each task
counts its rows, and what the driver adds up is one row for each task.

Defined results: nulls in any column are told from empty texts; a null group is a group, before all others; null ids come
first, untampered; rows alike in group and id stand by their leaves, and each has a place of its own; a very long text is hashed
as one; an empty table gives an empty table; columns beside those named don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

FAN = 8
#: Levels of the blocks that a task sweeps over, each over FAN**LEVELS nodes.
LEVELS = 4
#: Rows that a task gives out together, or those of one block.
OUT_ROWS = 4096


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as length, colon and text; a null as a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...], doc_id: str, group: str, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, g, leaf, found): found is the leaf of the row as it is met later, `tampered` columns in the place of its own in the rows `where`."""
    own = leaf([F.col(c) for c in columns])
    found = own
    if tampered:
        changed = leaf([tampered.get(c, F.col(c)) for c in columns])
        found = F.when(F.lit(True) if where is None else where, changed)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(group).alias("g"), own.alias("leaf"), found.alias("found"))
    return rows.withColumn("found", F.coalesce("found", "leaf"))


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with i, each row's place in its group g by the columns of `order` (nulls first).

    Rows alike in all of these may lie in several partitions, so that none has to hold many of them.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "_salt")]
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    place = df.columns.index("g")

    def number(it):
        part, run, last, at = TaskContext.get().partitionId(), -1, None, 0
        for batch in it:
            n = len(batch)
            if not n:
                continue
            coded = batch.column(place).dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change = np.concatenate([[run < 0 or batch.column(place)[0].as_py() != last], code[1:] != code[:-1]])
            runs = run + np.cumsum(change)
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))  # -1: goes on from the batch before
            here = np.arange(n) - np.where(start < 0, -at, start)
            run, last, at = int(runs[-1]), batch.column(place)[n - 1].as_py(), int(here[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(here)], names=[*batch.schema.names, "_part", "_run", "_at"])

    sorted_ = written(mapped(dealt, number, f"{kinds}, _part int, _run long, _at long"), "merkle-order", lasting=True)
    ends = sorted_.groupBy("_part").agg(
        F.max("_run").alias("runs"),
        F.min_by(F.struct("g"), "_run").alias("first"),
        F.max_by(F.struct("g"), "_run").alias("last"),
        (F.max_by("_at", F.struct("_run", "_at")) + 1).alias("n"),
    )
    bases, group, before = [], None, 0
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row for each partition
        goes_on = group is not None and row["first"] == group
        bases.append((row["_part"], before if goes_on else 0))
        before = row["n"] + (before if goes_on and not row["runs"] else 0)
        group = row["last"]
    small = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    i = F.col("_at") + F.when(F.col("_run") == 0, F.col("_base")).otherwise(0)
    return sorted_.join(small, "_part").select(*df.columns, i.alias("i"))


def height(n: int, later: bool, levels: int) -> int:
    """Levels above a block's n nodes: all of them if the block is full or not its group's first, else as many as lead to one node."""
    if later or n == FAN**levels:
        return levels
    h = 0
    while FAN**h < n:
        h += 1
    return h


class Sweep:
    """The inner nodes over some nodes' digests, and their top."""

    def __init__(self, digests: list[str], levels: int):
        self.n, self.levels = len(digests), levels
        #: (label, children), labels ascending
        self.nodes: list[tuple[tuple[int, int, int], list[str]]] = []
        self.top = digests[0]
        if not levels:
            return
        queue: list[tuple[tuple[int, int, int], int, str]] = []
        for i, digest in enumerate(digests):
            heapq.heappush(queue, (self.label(1, i // FAN), i, digest))
            while queue and queue[0][0][0] == i:
                label, children = queue[0][0], []
                while queue and queue[0][0] == label:
                    children.append(heapq.heappop(queue)[2])
                self.nodes.append((label, children))
                _, level, k = label
                self.top = sha("".join(children))
                if level < levels:
                    heapq.heappush(queue, (self.label(level + 1, k // FAN), k, self.top))

    def label(self, level: int, k: int) -> tuple[int, int, int]:
        return min((k + 1) * FAN**level, self.n) - 1, level, k

    def proofs(self, suffix: str) -> list[str]:
        """Each lower node's path: on every level the digests before it, a full stop, and those behind it, then a slash; `suffix` is the top's."""
        out = [suffix] * self.n
        if not self.levels:
            return out
        queue = [(tuple(-x for x in self.nodes[-1][0]), suffix)]
        for label, children in reversed(self.nodes):
            _, rest = heapq.heappop(queue)  # the largest label, which is this node's
            _, level, k = label
            for c in range(len(children)):
                path = f"{''.join(children[:c])}.{''.join(children[c + 1 :])}/{rest}"
                if level == 1:
                    out[k * FAN + c] = path
                else:
                    heapq.heappush(queue, (tuple(-x for x in self.label(level - 1, k * FAN + c)), path))
        return out


def proof_digest(path: str) -> str:
    return sha(path.replace(".", "").replace("/", ""))


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for level in path.split("/")[:-1]:
        before, behind = level.split(".")
        digest = sha(before + digest + behind)
    return digest


def _blocks(it: Iterator[pa.RecordBatch], made: Callable[[tuple, list[tuple]], list[list]], kinds: dict[str, pa.DataType | int]) -> Iterator[pa.RecordBatch]:
    """The columns that `made` gives for the rows of each block, which are alike in their first two values, g and b.

    kinds: the columns' types, or whose column of the input they have the type of.
    """
    first = next(it, None)
    if first is None:
        return
    schema = pa.schema([(name, first.schema.field(kind).type if isinstance(kind, int) else kind) for name, kind in kinds.items()])
    key, held, done, n = None, [], [[] for _ in kinds], 0

    def close():
        for column, values in zip(done, made(key, held), strict=True):
            column.extend(values)

    for row in _rows(chain([first], it)):
        if held and row[:2] != key:
            close()
            held = []
            if len(done[0]) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema, strict=True)], schema=schema)
                done = [[] for _ in kinds]
        key = row[:2]
        held.append(row[2:])
    if held:
        close()
    if done[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema, strict=True)], schema=schema)


def block_of(levels: int) -> Column:
    return F.floor(F.col("i") / F.lit(FAN**levels)).cast("long")


def _dealt(df: DataFrame) -> DataFrame:
    """A block's rows side by side, in the order of their labels."""
    return df.repartition("g", "b").sortWithinPartitions(F.col("g").asc_nulls_first(), "b", "i")


def tops(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, i, digest) of the nodes over each block of (g, i, digest)."""
    kind = nodes.schema["g"].dataType.simpleString()

    def top(key, held):
        g, b = key
        return [[g], [b], [Sweep([d for _, d in held], height(len(held), b > 0, levels)).top]]

    dealt = _dealt(nodes.select("g", block_of(levels).alias("b"), "i", "digest"))
    return mapped(dealt, lambda it: _blocks(it, top, {"g": 0, "i": pa.int64(), "digest": pa.string()}), f"g {kind}, i long, digest string")


def rising(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each round, from those given to one for each group."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("i")).first()[0] or 0) > 0:
        rounds.append(written(tops(rounds[-1], levels), "merkle-tops", lasting=True))
    return rounds


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, names: list[str], levels: int) -> DataFrame:
    """(g, b, i, *names) of the nodes, and before each block's a row of place -1, its first two of `names` being path and subroot."""
    own = nodes.select("g", block_of(levels).alias("b"), "i", *names)
    rest = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in names[2:]]
    sent = suffixes.select("g", F.col("i").alias("b"), F.lit(-1).cast("long").alias("i"), F.col("path").alias(names[0]), F.col("subroot").alias(names[1]), *rest)
    return _dealt(own.unionByName(sent))


def _opened(key: tuple, held: list[tuple], levels: int) -> tuple[list[tuple], list[str], str]:
    """A block's own rows, their paths and their group's subroot."""
    (place, suffix, subroot, *_), own = held[0], held[1:]
    if place != -1 or not own or own[0][0] < 0:
        raise ValueError("a block's suffix is missing")
    return own, Sweep([x[1] for x in own], height(len(own), key[1] > 0, levels)).proofs(suffix), subroot


def falling(nodes: DataFrame, suffixes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, i, path, subroot) of `nodes`, from (g, i, path, subroot) of the nodes over their blocks."""
    kind = nodes.schema["g"].dataType.simpleString()

    def down(key, held):
        own, paths, subroot = _opened(key, held, levels)
        return [[key[0]] * len(own), [x[0] for x in own], paths, [subroot] * len(own)]

    dealt = _with_suffixes(nodes.withColumn("none", F.lit(None).cast("string")), suffixes, ["digest", "none"], levels)
    return mapped(dealt, lambda it: _blocks(it, down, {"g": 0, "i": pa.int64(), "path": pa.string(), "subroot": pa.string()}), f"g {kind}, i long, path string, subroot string")


def descended(rounds: list[DataFrame], suffixes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Suffixes of the nodes over the lowest blocks, from those of one node for each group."""
    for nodes in reversed(rounds[1:-1]):
        suffixes = written(falling(nodes, suffixes, levels), "merkle-suffixes", lasting=True)
    return suffixes


def proven(rows: DataFrame, suffixes: DataFrame, root: str, with_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """The last step of the way back: rows (id, g, i, leaf, found) with their proofs, and what `found` folds to."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def down(key, held):
        own, paths, subroot = _opened(key, held, levels)
        n, folded = len(own), [fold(x[2], p) for x, p in zip(own, paths, strict=True)]
        columns = [[x[3] for x in own], [x[1] for x in own], [subroot] * n, [root] * n, list(map(proof_digest, paths)), folded, [f == root for f in folded]]
        return columns + [paths] * with_proofs

    kinds = {"id": 5} | {c: pa.string() for c in names} | {"verified": pa.bool_()} | ({"proof": pa.string()} if with_proofs else {})
    schema = ", ".join([f"id {kind}", *(f"{c} string" for c in names), "verified boolean", *["proof string"] * with_proofs])
    return mapped(_with_suffixes(rows, suffixes, ["leaf", "found", "id"], levels), lambda it: _blocks(it, down, kinds), schema)


def manifest(docs: DataFrame, columns: tuple[str, ...], doc_id: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None, with_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and the proof if asked for.

    `verified` says whether the row, as `leaves` meets it later, still leads to the root. A proof has for each level the
    digests before the node, a full stop, those behind it, and a slash; `fold` follows it.
    """
    made = written(leaves(docs, columns, doc_id, group, tampered, where), "merkle-leaves", lasting=True)
    rows = written(numbered(made, ["id", "leaf"]), "merkle-rows", lasting=True)
    trees = rising(rows.select("g", "i", F.col("leaf").alias("digest")), levels)
    over = numbered(trees[-1].select(F.lit(0).alias("g"), F.col("g").alias("of"), "digest"), ["of"])
    tree = rising(over.select("g", "i", "digest"), levels)
    top = tree[-1].first()
    start = tree[-1].select("g", "i", F.lit("").alias("path"), F.lit("").alias("subroot"))
    paths = falling(tree[0], descended(tree, start, levels), levels).select("i", "path")
    above = paths.join(over.select("i", F.col("of").alias("g"), F.col("digest").alias("subroot")), "i")
    below = descended(trees, above.select("g", F.lit(0).cast("long").alias("i"), "path", "subroot"), levels)
    return proven(rows, below, top["digest"] if top else "", with_proofs, levels).withColumnRenamed("id", doc_id)
