"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text's weighted set holds its distinct five-word shingles, a shingle found c times with weight 1 + ln c (a text below
five words is one shingle). Every shingle has a Poisson process whose rate is its weight and whose random stream its
hash; each arrival falls into one of SLOTS slots, and a slot keeps the shingle that arrives first. A text's processes
stop once an arrival is later than every slot's first. Two texts agree in a slot with the probability Jaccard similarity
of their weighted sets, which at weights of 1 is the Jaccard similarity of the sets, whatever their sizes.

Verification takes the similarity that signatures at weight 1 estimate: distinct shingles in common over all distinct
shingles, at least `threshold`. BANDS bands of six slots find a pair of similarity 0.8 with a chance of 1 - 6e-5, if its
signatures are at weight 1. Weights from repeats can bring the probability Jaccard similarity far below the verified one,
so a text with repeated shingles has the bands of its shingles at weight 1 besides. The streams are the same, so a text
without repeats has these bands already, and the chance holds for every pair, whatever its counts.

Equal word sequences (128-bit hash) are one node from the start. A band's members are not paired with each other: each is
compared with the member that collides most in the corpus, then, as long as that helps, with other leaders. What a band
still holds in different classes mostly shares a passage that many documents have. Of two sets so similar, each has one
of the other's rarest shingles among its own rarest few, so the rest is grouped by these instead: members go through
leaders again, and only those still apart are compared one by one, a key's members in blocks. No link between members of a
band is lost. A comparison sends members' texts to the leader's in chunks of CHUNK, so neither a text is repeated by pair
nor a crowded leader held by one task. Classes are the connected components, found by label propagation over written
tables, never on the driver; the least id names a class.

Defined results: null and empty texts have the same (empty) word sequence and form one class without near copies; a
null id is the least; repeated rows share a class; ties between leaders go to the larger node; very long texts are
compared whole; an empty table has no classes; other columns don't matter, whatever their names. A shingle's hash has 64
bits, so two texts of a million shingles each share one by chance with a probability below 1e-7. Ids are integers, -2**63
excepted (it stands for null); under ANSI rules an id of another type that is no integer is an error.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, free_name, joined, mapped, mix64, passing, per_text, phrase_hashes, sequence_hashes, slices, text_bytes, word_hashes, written

SHINGLE = 5
SLOTS = 192
BANDS = 32
THRESHOLD = 0.8
#: Most leaders that the members of a group are compared with before what is still apart is looked at more closely.
LEADER_ROUNDS = 3
#: Members that are compared with a leader in one task, and members of a key that meet each other in one.
CHUNK = 256
#: Sizes of sets whose overlaps are bounded together differ by this factor at most.
SIZE_STEP = 1.1
NO_ID = -(1 << 63)


def shingles(words: Words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, their counts, and each text's first, with the total at the end."""
    if not hashes.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(words.counts) + 1, np.int64)
    own = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    first = np.concatenate([[0], np.cumsum(own)])
    begin = np.repeat(words.first[:-1], own) + np.arange(first[-1]) - np.repeat(first[:-1], own)
    made = np.empty(len(begin), np.uint64)
    full = np.repeat(words.counts >= size, own)
    made[full] = phrase_hashes(hashes[:1], size)[0, begin[full]]
    at, n = begin[~full], np.repeat(words.counts, own)[~full]
    short = hashes[:1, at]
    for k in range(1, size - 1):
        more = n > k
        short[:, more] = joined(short[:, more], hashes[:1, at[more] + k])
    made[~full] = short[0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        made[a:b].sort()
    text = np.repeat(np.arange(len(own)), own)
    new = np.flatnonzero(np.append(True, (made[1:] != made[:-1]) | (text[1:] != text[:-1]))) if len(made) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(made)))
    return made[new], count, np.searchsorted(text[new], np.arange(len(own) + 1))


def signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(texts x slots) the element that comes first in each slot; 0 for a text without elements."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    best = np.full(texts * slots, np.inf)
    winner = np.zeros(texts * slots, np.uint64)
    now = np.zeros(len(element))
    done = 0
    while len(element):
        many = int(min(64, max(1, 200_000 // len(element))))  # arrivals drawn together for few elements
        turns = np.arange(done, done + many, dtype=np.uint64)
        seeds = element[:, None] ^ mix64(turns, 5)[None, :]
        gap = -np.log1p(-((mix64(seeds, 6) >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        at = now[:, None] + np.cumsum(gap, axis=1) / weight[:, None]
        place = (text * slots)[:, None] + ((mix64(seeds, 7) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        flat, when = place.ravel(), at.ravel()
        np.minimum.at(best, flat, when)
        won = when == best[flat]
        winner[flat[won]] = np.repeat(element, many)[won]
        done += many
        on = at[:, -1] < best.reshape(texts, slots).max(axis=1)[text]
        element, weight, text, now = element[on], weight[on], text[on], at[on, -1]
    return winner.reshape(texts, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    key = np.zeros((len(signature), bands), np.uint64) + mix64(np.arange(bands, dtype=np.uint64), 8)[None, :]
    for r in range(rows):
        key = mix64(key ^ signature[:, r::rows][:, :bands], 9 + r)
    return key


def all_bands(element: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each text, and each text's first, with the total at the end: by weight, and where shingles are repeated by weight 1 too."""
    own = np.diff(first)
    keys = np.zeros((len(own), 2 * BANDS), np.uint64)
    keys[:, :BANDS] = band_keys(signatures(element, 1 + np.log(count), first))
    fresh = np.zeros(keys.shape, bool)
    fresh[:, :BANDS] = (own > 0)[:, None]
    again = per_text(count > 1, first) > 0
    if again.any():
        kept = np.repeat(again, own)
        plain = band_keys(signatures(element[kept], np.ones(np.count_nonzero(kept)), np.concatenate([[0], np.cumsum(own[again])])))
        keys[again, BANDS:] = plain
        fresh[again, BANDS:] = plain != keys[again, :BANDS]
    return keys[fresh], np.concatenate([[0], np.cumsum(fresh.sum(axis=1))])


def sketched(rows: DataFrame) -> DataFrame:
    """(id, tag, k1, k2, n_shingles, bands) of each row of (id, tag, text): k1 and k2 name the word sequence."""

    def batches(it):
        for batch in it:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes = word_hashes(words)
                k1, k2 = (pa.array(np.ascontiguousarray(k).view(np.int64)) for k in sequence_hashes(words, hashes))
                element, count, first = shingles(words, hashes)
                own = np.diff(first)
                keys, ends = all_bands(element, count, first)
                bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), k1, k2, pa.array(own), bands], names=["id", "tag", "k1", "k2", "n_shingles", "bands"])

    return mapped(rows, batches, "id long, tag long, k1 long, k2 long, n_shingles long, bands array<long>")


def packed(rows: DataFrame) -> DataFrame:
    """(id, tag, packed) of each row of (id, tag, text): texts travel compressed, as several joins move them."""

    def batches(it):
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in it:
            made = pa.array([zip_((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["id", "tag", "packed"])

    return mapped(rows, batches, "id long, tag long, packed binary")


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) of packed texts, about SLICE_BYTES of them at a time."""
    unzip = zstandard.ZstdDecompressor().decompress
    held, size, since = [], 0, 0
    for k, blob in enumerate(column):
        held.append(unzip(blob.as_py()))
        size += len(held[-1])
        if size >= SLICE_BYTES or k + 1 == len(column):
            yield since, k + 1, Words(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])]))
            held, size, since = [], 0, k + 1


def similar_to_leader(rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the members u that are similar enough to their leader v.

    rows: (v, chunk, node, packed), sorted within a partition by v and chunk, each chunk's first row the leader itself.
    """

    def batches(it):
        leader, now = None, None
        for batch in it:
            us, vs = [], []
            v, chunk, node = (batch.column(k).to_pylist() for k in range(3))
            for i, j, words in unpacked(batch.column(3)):
                element, _, first = shingles(words, word_hashes(words))
                for k in range(i, j):
                    own = element[first[k - i] : first[k - i + 1]]
                    if (v[k], chunk[k]) != now:
                        now, leader = (v[k], chunk[k]), own.copy()
                    else:
                        at = np.searchsorted(leader, own)
                        same = np.count_nonzero(leader[np.minimum(at, len(leader) - 1)] == own)
                        if same >= threshold * (len(leader) + len(own) - same):
                            us.append(node[k])
                            vs.append(v[k])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return mapped(rows, batches, "u long, v long")


def linked(candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the candidates (u, v, nu, nv) that are similar enough; sizes too far apart are passed over, as they can't be."""
    possible = written(candidates.where(F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")).select("u", "v").distinct(), "pairs")
    many = possible.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = possible.join(many, "v").select("u", "v", F.pmod(F.xxhash64("u"), "chunks").alias("chunk"))
    members = dealt.join(texts, dealt["u"] == texts["node"]).select("v", "chunk", "node", "packed", F.lit(1).alias("role"))
    leaders = many.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    leaders = leaders.join(texts, leaders["v"] == texts["node"]).select("v", "chunk", "node", "packed", F.lit(0).alias("role"))
    rows = leaders.union(members).repartition("v", "chunk").sortWithinPartitions("v", "chunk", "role", "node")
    return similar_to_leader(rows.select("v", "chunk", "node", "packed"), threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v): the least node that it is connected with."""
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("other"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.col("component").alias("old"), F.least("component", "other").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("further"))
        fresh = written(least.join(jump, "step").select("node", "old", F.least("step", "further").alias("component")), "labels")
        labels = fresh.select("node", "component")
        if fresh.where("component != old").isEmpty():
            return labels


def _against_leader(group: DataFrame, order: F.Column) -> DataFrame:
    """Each member (key, node, n, component) with its group's leader, if that is of another component."""
    leader = written(group.groupBy("key").agg(F.max(F.struct(order.alias("o"), "node", "n", "component")).alias("l")), "leaders")
    both = group.join(leader, "key").where("component != l.component")
    return both.select(F.col("node").alias("u"), F.col("l.node").alias("v"), F.col("n").alias("nu"), F.col("l.n").alias("nv"))


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (node, component) after the links (u, v) have joined components; only links between two of them move on."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    lifted = more.join(of("u"), "u").join(of("v"), "v").where("uc != vc").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
    roots = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return written(found.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")


def _by_leaders(group: DataFrame, found: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(components, members of groups that are still apart, or None) after comparing members (key, node, n, degree) with leaders.

    The first leader is the node of the highest degree, the next ones follow a hash; it ends when a round helps little.
    """
    every, before = group, None
    group = group.join(found, "node")
    for turn in range(LEADER_ROUNDS):
        order = F.col("degree") if turn == 0 else F.xxhash64("node", F.lit(turn))
        found = _merged(found, written(linked(_against_leader(group, order), texts, threshold), "edges"))
        named = every.join(found, "node")
        apart = written(named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key"), "open-keys")
        group = written(named.join(apart, "key", "left_semi"), "open-groups")
        left = group.count()
        if not left:
            return found, None
        if before is not None and left > 0.8 * before:
            break
        before = left
    return found, group


def _overlap(n: F.Column, m: F.Column, threshold: float) -> F.Column:
    """The least common shingles of similar sets of n and m shingles; a little less, so that rounding never raises it."""
    both = F.ceil(threshold / (1 + threshold) * (n + m) - 1e-6)
    return F.greatest(both, F.ceil(threshold * n - 1e-6), F.ceil(threshold * m - 1e-6))


def _size_class(n: F.Column) -> F.Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP) + 1e-9)


def _rare_shingles(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(key, node, n, degree, place) of the shingles that a similar set must share one of: each node's rarest ones.

    Order is by the number of open nodes with the shingle, then its hash. Sets of n and m shingles have at least o =
    _overlap(n, m) in common, so the first common one is among the first n - o + 1 of the one and m - o + 1 of the other.
    A key is a shingle with the size classes of both sides, and o is that of the class's smallest partner. Shingles that
    only one node has fill its first places and match nothing: a copy with more edits than o allows meets nobody,
    however many copies of the same text there are.
    """
    nodes = open_.select("node", "n", "degree").distinct()

    def batches(it):
        for batch in it:
            for i, j, words in unpacked(batch.column(1)):
                element, _, first = shingles(words, word_hashes(words))
                rows = pa.array(np.repeat(np.arange(i, j), np.diff(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(element.view(np.int64))], names=["node", "shingle"])

    open_texts = texts.join(nodes.select("node"), "node", "left_semi").select("node", "packed")
    rows = mapped(open_texts, batches, "node long, shingle long")
    often = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle-counts")
    shared = rows.join(often, "shingle")
    order = Window.partitionBy("node").orderBy("df", "shingle")
    placed = shared.withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("node"))).join(nodes, "node")
    n = F.col("n")
    placed = placed.withColumn("place", n - F.col("shared") + F.col("rank")).where(F.col("place") <= n - F.ceil(threshold * n - 1e-6) + 1)
    partners = F.sequence(_size_class(F.greatest(F.lit(1), F.ceil(threshold * n - 1e-6))), _size_class(F.floor(n / threshold + 1e-6)))
    each = placed.withColumn("own", _size_class(n)).withColumn("other", F.explode(partners))
    smallest = F.greatest(F.ceil(F.pow(F.lit(SIZE_STEP), F.col("other")) - 1e-6), F.ceil(threshold * n - 1e-6))
    kept = each.where(F.col("place") <= n - _overlap(n, smallest, threshold) + 1)
    return kept.select(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n", "degree", "place")


def _apart(group: DataFrame, threshold: float) -> DataFrame:
    """Members of one key that are still in different components, each with each, where their places allow a link."""
    sized = group.join(group.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts")), "key")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    # a pair meets in the one block that holds the part of the first by the part of the second
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    mine = sized.withColumn("with", each).select("key", "part", "with", "node", "n", "component", "place")
    other = sized.withColumn("of", each).select("key", F.col("of").alias("part"), F.col("part").alias("with"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("component").alias("c"), F.col("place").alias("pv"))
    o = _overlap(F.col("n"), F.col("nv"), threshold)
    room = F.least("place", "pv") + F.least(F.col("n") - F.col("place"), F.col("nv") - F.col("pv"))
    allowed = (F.col("place") <= F.col("n") - o + 1) & (F.col("pv") <= F.col("nv") - o + 1) & (room >= o)
    return mine.join(other, ["key", "part", "with"]).where((F.col("component") < F.col("c")) & allowed).select(F.col("node").alias("u"), "v", F.col("n").alias("nu"), "nv")


def _named(docs: DataFrame, doc_id: str, text: str) -> tuple[F.Column, F.Column]:
    """The id and the tag (the text's hash) of a row: what tells apart rows that share an id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, tag, copies, class_id, class_tag) for each distinct (id, text hash), found `copies` times, written as a table.

    class_id and class_tag are those of the row that names the class, which is a row itself.
    """
    with passing(docs.sparkSession):
        return written(_classes(docs, doc_id, text, threshold), "classes", lasting=True)


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    rows = docs.select(*_named(docs, doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = written(sketched(rows), "sketches")
    names = table.groupBy("id", "tag", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    heads = table.groupBy("k1", "k2").agg(F.min(F.struct("id", "tag")).alias("head"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # numbers of rows of a table, so short names that no two word sequences share
    heads = written(heads.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", "head.id", "head.tag", "bands"), "nodes")

    keys = heads.select("node", F.explode("bands").alias("band"))
    # a table of its own, so that a crowded band's side of the join is a shuffle that Spark can split
    crowded = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "crowded-bands")
    members = written(keys.join(crowded, "band").select("band", "node", "members"), "bands")
    heads = heads.drop("bands")
    degree = written(members.groupBy("node").agg(F.sum("members").alias("degree")).join(heads, "node").select("node", "n", "degree", "id", "tag"), "band-nodes")
    named, blobs = degree.join(names.select("id", "tag", "copies"), ["id", "tag"]).select("node", "id", "tag", "copies"), packed(rows)
    # a text for each node: whole rows are compared only where a row is repeated
    once, again = (blobs.join(named.where(c).select("node", "id", "tag"), ["id", "tag"]).select("node", "packed") for c in ("copies = 1", "copies > 1"))
    texts = written(once.unionByName(again.dropDuplicates(["node"])), "band-texts")
    start = written(members.select(F.col("band").alias("key"), "node").join(degree.select("node", "n", "degree"), "node"), "band-members")

    found, open_ = _by_leaders(start, degree.select("node", F.col("node").alias("component")), texts, threshold)
    if open_ is not None:
        rare = written(_rare_shingles(open_, texts, threshold), "rare-shingles")
        if not rare.isEmpty():
            found, open_ = _by_leaders(rare, found, texts, threshold)
            if open_ is not None:
                found = _merged(found, written(linked(_apart(open_, threshold), texts, threshold), "edges"))
    placed = heads.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min(F.struct("id", "tag")).alias("c"))
    placed = placed.join(best, "component").select("k1", "k2", F.col("c.id").alias("class_id"), F.col("c.tag").alias("class_tag"))
    return names.join(placed, ["k1", "k2"]).select("id", "tag", "copies", "class_id", "class_tag")


def _public(column: str) -> F.Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row."""
    made = classes(docs, doc_id, text, threshold).select("id", "tag", "class_id")
    rows = docs.select(*_named(docs, doc_id, text))
    return rows.join(made, ["id", "tag"]).select(_public("id").alias("doc_id"), _public("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row of the least id of each class, with all its columns; one of several rows alike in id and text."""
    a, b = free_name(docs, "__id"), free_name(docs, "__tag")
    heads = classes(docs, doc_id, text, threshold).where("id = class_id and tag = class_tag").select(F.col("id").alias(a), F.col("tag").alias(b), "copies")
    number, tag = _named(docs, doc_id, text)
    marked = docs.withColumn(a, number).withColumn(b, tag)
    # whole rows are compared only where a row is repeated
    once = marked.join(heads.where("copies = 1").select(a, b), [a, b])
    again = marked.join(heads.where("copies > 1").select(a, b), [a, b]).dropDuplicates([a, b])
    return once.unionByName(again).select(*docs.columns)
