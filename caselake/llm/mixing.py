"""Mixing sources to target weights by Pfair scheduling: release times, deadlines, earliest deadline first.

A source's documents, in a seeded pseudo-random order, are cut into blocks of `block_size` characters; a document belongs
to the block that it starts in. Output time is counted in slots of one block. Block k (from 0) of a source whose share of
the slots is w / W is released at floor(k W / w) and due at ceil((k + 1) W / w); in each slot the released block with the
earliest deadline goes out, so at any time a source has had its share to within less than one block.

Weights are integers, so the schedule repeats after W slots: one period is simulated, and every block finds its slot by
division. When a source runs out a new phase begins with those that are left, and no document is dropped. The table of
phases is bounded by the weights given, not by the data: at most (sources + 1)**2 rows and (sources + 1) * resolution slots.
Sources without a weight, and null sources, share the weight `other` as if they were one.

Running totals inside a source are two-level (buckets of the order, then rows of a bucket), so one source may hold most
rows; rows alike in id, source and text are one row with a count until they have their place, so they may be most rows too.
Defined results: null and empty texts have size 0 and keep their place in the order; a very long text fills several blocks
and belongs to the first; repeated rows follow each other; an empty table stays empty; columns beside those named don't
matter, whatever their names, and are kept by `in_order`.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

#: Copies of one row that are told apart in one task.
COPIES = 10_000


@dataclass(frozen=True)
class Targets:
    weights: dict = field(default_factory=dict)  # source: share, of any scale
    other: float = 1.0  # the share of all other sources together
    block_size: int = 20_000
    resolution: int = 1000  # slots in a period of the full set
    seed: int = 1
    bucket_rows: int = 20_000


def whole_weights(shares: dict, resolution: int) -> dict:
    """Positive integers of sum `resolution` in proportion to the shares (largest remainders)."""
    if any(v <= 0 for v in shares.values()) or len(shares) > resolution:
        raise ValueError("shares must be positive and fewer than the resolution")
    total = sum(shares.values())
    exact = {k: v * resolution / total for k, v in shares.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    k = 0
    while sum(out.values()) != resolution:
        step = 1 if sum(out.values()) < resolution else -1
        name = order[k % len(order)] if step > 0 else max(out, key=lambda n: (out[n], str(n)))
        out[name] += step
        k += 1
    return out


def period(weights: dict) -> dict:
    """The slots of each source's blocks in one period, by earliest deadline first."""
    total = sum(weights.values())
    waiting = sorted((k * total // w, -(-(k + 1) * total // w), str(name), name) for name, w in weights.items() for k in range(w))
    slots: dict = {name: [] for name in weights}
    ready: list = []
    at = 0
    for t in range(total):
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, (waiting[at][1], waiting[at][2], waiting[at][3]))
            at += 1
        due, _, name = heapq.heappop(ready)
        if due <= t:
            raise ValueError("a deadline is missed")
        slots[name].append(t)
    return slots


def phases(blocks: dict, weights: dict) -> list[tuple]:
    """(source, first block, blocks, first slot, slots in a period, the source's slots in it) until all blocks are out."""
    used, now, out = dict.fromkeys(blocks, 0), 0, []
    while active := {s: weights[s] for s in blocks if used[s] < blocks[s]}:
        slots, total = period(active), sum(active.values())

        def finish(s, slots=slots, total=total, active=active):
            k = blocks[s] - used[s] - 1
            return k // active[s] * total + slots[s][k % active[s]] + 1

        end = min(map(finish, active))
        for s, w in active.items():
            n = end // total * w + sum(x < end % total for x in slots[s])
            if n:
                out.append((s, used[s], n, now, total, slots[s]))
            used[s] += n
        now += end
    return out


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """What the schedule needs; the text's hash and length are taken at the scan, so that no text is sorted."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("size"))


def _placed(docs: DataFrame, targets: Targets, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with `copies`, their source's `group` and the characters before the first in it (at); and the phases."""
    slim = _slim(docs, doc_id, text, source).groupBy("doc_id", "source", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    slim = written(slim, "mix-rows")
    group = F.when(F.col("source").isin(list(targets.weights)), F.concat(F.lit("="), F.col("source"))).otherwise(F.lit("*"))
    rows = slim.withColumn("group", F.coalesce(group, F.lit("*"))).withColumn("key", F.xxhash64("doc_id", "hash", F.lit(targets.seed)))
    bits = (slim.count() // targets.bucket_rows).bit_length()
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    length = F.sum(F.col("size") * F.col("copies"))
    sums = written(rows.groupBy("group", "bucket").agg(length.alias("total")), "mix-buckets")
    earlier = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("group", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    # as many rows as there are weights, and one
    totals = {r["group"]: r["total"] for r in sums.groupBy("group").agg(F.sum("total").alias("total")).collect()}
    blocks = {g: max(1, -(-t // targets.block_size)) for g, t in totals.items()}
    shares = {f"={s}": w for s, w in targets.weights.items()} | {"*": targets.other}
    table = [(*p, blocks[p[0]] - 1) for p in phases(blocks, whole_weights(shares, targets.resolution))]
    plan = docs.sparkSession.createDataFrame(table, "group string, first long, many long, since long, total long, places array<int>, last long")
    order = Window.partitionBy("group", "bucket").orderBy("key", "doc_id", "source").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(before, ["group", "bucket"]).withColumn("at", F.col("before") + F.coalesce(length.over(order), F.lit(0)))
    return placed.select("doc_id", "source", "hash", "size", "copies", "group", "at"), plan


def _in_slots(placed: DataFrame, plan: DataFrame, targets: Targets) -> DataFrame:
    """(doc_id, source, hash, size, slot, block, offset) of rows with a place in their group."""
    joined = placed.join(F.broadcast(plan), "group")
    # a row without size may stand behind the last character
    joined = joined.withColumn("block", F.least(F.floor(F.col("at") / targets.block_size), F.col("last")))
    joined = joined.where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("many")))
    step, w = F.col("block") - F.col("first"), F.size("places").cast("long")
    slot = F.col("since") + F.floor(step / w) * F.col("total") + F.element_at("places", (step % w + 1).cast("int"))
    return joined.select("doc_id", "source", "hash", "size", slot.cast("long").alias("slot"), "block", (F.col("at") - F.col("block") * targets.block_size).alias("offset"))


def mixed(docs: DataFrame, targets: Targets, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, hash, size, slot, block, offset) of each row: the mix is the order of slot and offset.

    block counts within the source; offset is the characters of the block before the row.
    """
    placed, plan = _placed(docs, targets, doc_id, text, source)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = placed.where(F.col("copies") <= COPIES).withColumn("copy", upto(F.col("copies")))
    parts = placed.where(F.col("copies") > COPIES).withColumn("part", upto(F.ceil(F.col("copies") / COPIES)))
    since = F.col("part") * COPIES
    parts = parts.repartition("hash", "doc_id", "part").withColumn("copy", F.explode(F.sequence(since, F.least(since + COPIES, F.col("copies")) - 1)))
    each = few.unionByName(parts.drop("part")).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    return _in_slots(each, plan, targets)


def with_places(docs: DataFrame, targets: Targets, place: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs and the column `place`, a struct of slot and offset; rows alike in id, source and text share the first of their places."""
    placed, plan = _placed(docs, targets, doc_id, text, source)
    places = written(_in_slots(placed, plan, targets), "mix")
    places = places.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("hash").alias("__x"), F.struct("slot", "offset").alias("__place"))
    hashed = free_name(docs, "__hash")
    marked = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("m")
    same = F.col(f"m.{doc_id}").eqNullSafe(F.col("p.__d")) & F.col(f"m.{source}").eqNullSafe(F.col("p.__s")) & (F.col(f"m.{hashed}") == F.col("p.__x"))
    return marked.join(places.alias("p"), same).select(*(F.col(f"m.{c}") for c in docs.columns), F.col("p.__place").alias(place))


def in_order(docs: DataFrame, targets: Targets, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs in the order of the mix: range-partitioned and sorted, so that its files are the mix from first to last.

    Rows alike in id, source and text stand together, at the first of their places.
    """
    place = free_name(docs, "__at")
    joined = with_places(docs, targets, place, doc_id, text, source)
    return joined.repartitionByRange(f"{place}.slot", f"{place}.offset").sortWithinPartitions(f"{place}.slot", f"{place}.offset", doc_id).select(*docs.columns)
