"""Removal of repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus.

A window is WINDOW consecutive words of one text. The reference is every text, cut into blocks; the index leads from a
phrase to the blocks that hold it and their places. It is spread by hash over Spark's partitions, and each text's phrases
visit the part of the index that could hold them, so a text is factored against every block without being sent to each:

1. Index. The windows of a text whose rarest-looking phrase (least hash of the GRAM-word phrases in the window, the
   leftmost of equals) is the same phrase form a block of at most WINDOW - GRAM + 1 windows. Equal windows have equal
   phrases, so whatever repeats, repeats under one phrase.
2. Blocks whose phrase occurs once in the corpus hold no repeated window. Of the others, equal blocks become one reference
   block with the place of its first copy (least id, tag and word) and of its last. A text's block that has an equal one
   elsewhere matches it as a whole: its words at `start` are the reference's words at `at`.
3. At factor boundaries equal phrases stand in unequal blocks. Each such reference block is cut into its windows, which
   are looked up among each other one by one; those of blocks that occur once become matches of one window.
4. Each text is then parsed from the left. Matches at the same distance from the same reference text continue each other,
   so they are extended over that reference's words as far as it goes on to match. At each place the longest such factor
   is taken; it has WINDOW words at least, and is a duplicate span. A window that begins inside a factor and ends beyond
   it opens the next one.

Blocks and windows are compared by 128-bit hashes of their words: among 10**12 of them, two unequal ones are taken for
equal with a chance of 1e-15, whatever the words. Hot phrases, passages and copies are summed in every task before a
shuffle, and only narrow rows join them back (Spark may split a hot key there).

Defined results: a null or empty text has no words; texts below WINDOW words lose nothing; a very long text is parsed
whole; the copies of a repeated row repeat each other, and have that row as reference; rows that share an id are told
apart by their texts' hashes; a null id is a reference of null id; an empty table gives an empty table; clashing column
names are harmless, since only the named columns are read. Ids are integers, -2**63 excepted (it stands for null); under
ANSI rules an id of another type that is no integer is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, joined, mapped, passing, phrase_hashes, slices, text_bytes, whole_phrases, word_hashes, written

WINDOW = 35
GRAM = 12
PLACE_BITS = 28
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, tag, text): tag is the text's hash, so that (id, tag) names a row even where ids repeat."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def blocks_of(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First word, windows, text, phrase hash and block hash (two rows) of each block; words are indices over all texts."""
    at = whole_phrases(words, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), np.zeros((2, 0), np.uint64)
    phrase = phrase_hashes(hashes[:1], gram)[0]
    n = len(phrase)
    # the least of the phrases in a window, with its place in the low bits, so that the leftmost of equals wins
    least = (phrase >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    span, width = 1, window - gram + 1
    while span < width:
        step = min(span, width - span)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        span += step
    place = (least[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(at)) - 1
    start, many = at[first], last - first + 1
    # the first and the last window hold all words of a block between them
    whole = phrase_hashes(hashes, window)
    block = joined(whole[:, start], whole[:, at[last]] ^ many.astype(np.uint64))
    return start, many, words.text_of_word()[start], phrase[place[first]], block


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def phrase_blocks(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, g1, g2, id, tag, start, n) of every block of every text."""

    def batches(it):
        for batch in it:
            data, offsets = text_bytes(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                start, n, text, h, g = blocks_of(words, word_hashes(words), window, gram)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(g[0]), _signed(g[1]), pa.array(ids[i + text]), pa.array(tags[i + text]), pa.array(start - words.first[text]), pa.array(n)],
                    names=["h", "g1", "g2", "id", "tag", "start", "n"],
                )

    return mapped(rows, batches, "h long, g1 long, g2 long, id long, tag long, start long, n long")


def block_windows(joined: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, id, tag, start, once) of the windows of the blocks [(start, n, once)] named beside each text."""

    def batches(it):
        for batch in it:
            data, offsets = text_bytes(batch.column(2))
            ids, tags, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = blocks.slice(i, j - i)
                count = pc.list_value_length(part).to_numpy()
                flat = part.flatten()
                first, n, once = flat.field("start").to_numpy(), flat.field("n").to_numpy(), flat.field("once").to_numpy(zero_copy_only=False)
                text = np.repeat(np.repeat(np.arange(j - i), count), n)
                start = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                hashed = phrase_hashes(word_hashes(words), window)[:, words.first[text] + start]
                yield pa.RecordBatch.from_arrays(
                    [*map(_signed, hashed), pa.array(ids[i + text]), pa.array(tags[i + text]), pa.array(start), pa.array(np.repeat(once, n))],
                    names=["w1", "w2", "id", "tag", "start", "once"],
                )

    return mapped(joined, batches, "w1 long, w2 long, id long, tag long, start long, once boolean")


def _reference(n: F.Column) -> F.Column:
    """A match (start, n, ref, tag, at): the first copy, or the last one where the first is this very place."""
    own = F.struct("id", "tag", "start")
    other = F.when(F.col("low") != own, F.col("low")).otherwise(F.col("high"))
    return F.struct(F.col("start"), n.alias("n"), other["id"].alias("ref"), other["tag"].alias("tag"), other["start"].alias("at"))


def matches(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, tag, matches): [(start, n, ref, tag, at)], the n windows from `start` on equal those from `at` on in the text (ref, tag)."""
    blocks = phrase_blocks(rows, window, gram)
    place = F.struct("id", "tag", "start")
    # tables of their own, so that a hot phrase's side of the joins below is a shuffle that Spark can split
    often = written(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "phrases")
    repeated = written(blocks.join(often, "h", "left_semi"), "phrase-blocks")
    index = repeated.groupBy("h", "g1", "g2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("low"), F.max(place).alias("high"), F.max("n").alias("n"))
    index = written(index, "reference-blocks")
    whole = repeated.join(index.where("c > 1").select("h", "g1", "g2", "low", "high"), ["h", "g1", "g2"])
    whole = whole.select("id", "tag", _reference(F.col("n")).alias("match"))
    # phrases with unequal blocks: a factor may end inside these
    uneven = written(index.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "uneven-phrases")
    cut = index.join(uneven, "h", "left_semi").groupBy("low.id", "low.tag").agg(F.collect_list(F.struct("low.start", "n", (F.col("c") == 1).alias("once"))).alias("blocks"))
    windows = written(block_windows(rows.join(cut, ["id", "tag"]).select("id", "tag", "text", "blocks"), window), "boundary-windows")
    shared = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("low"), F.max(place).alias("high")).where("c > 1").drop("c")
    single = windows.where("once").join(written(shared, "shared-windows"), ["w1", "w2"])
    single = single.select("id", "tag", _reference(F.lit(1).cast("long")).alias("match"))
    return whole.unionByName(single).groupBy("id", "tag").agg(F.collect_set("match").alias("matches"))


def extended(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs (doc, start, end, ref, tag, shift) of matches that continue each other, by doc and start.

    found: doc, start, n, ref, tag and at of matches. A run's windows from start to end equal those of the reference text
    `shift` words further on.
    """
    doc, start, ref, tag = (found[k] for k in ("doc", "start", "ref", "tag"))
    end, shift = start + found["n"], found["at"] - start
    order = np.lexsort((start, shift, tag, ref, doc))
    doc, start, end, ref, tag, shift = (x[order] for x in (doc, start, end, ref, tag, shift))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (tag[1:] != tag[:-1]) | (shift[1:] != shift[:-1])
    level = np.cumsum(fresh) << 32  # above every place, so that the running largest end begins anew with each group
    reach = np.maximum.accumulate(end + level) - level
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    runs = {"doc": doc[first], "start": start[first], "end": reach[last], "ref": ref[first], "tag": tag[first], "shift": shift[first]}
    order = np.lexsort((runs["start"], runs["doc"]))
    return {k: x[order] for k, x in runs.items()}


def parse(runs: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, reference, its first word) from a text's runs (start, end, reference, shift) by start."""
    out, k, done, best = [], 0, 0, None
    while True:
        while k < len(runs) and runs[k][0] <= done:  # of those known at this place, the one that goes on furthest
            if best is None or runs[k][1] > best[1]:
                best = runs[k]
            k += 1
        if best is not None and best[1] > done:
            start = max(best[0], done)
            out.append((start, best[1] - start + window - 1, best[2], start + best[3]))
            done = best[1]
        elif k < len(runs):
            done = runs[k][0]
        else:
            return out


def kept_words(text: str, factors: list[tuple[int, int, int, int]]) -> tuple[int, list[bytes]]:
    words = text.encode().split()
    out, at = [], 0
    for start, n, *_ in factors:
        out += words[at:start]
        at = max(at, start + n)
    return len(words), out + words[at:]


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text with the kept words joined by one space, n_words, n_removed, kept_sha256 and the factors of every row.

    A factor: n_words words from word `start` on are those from word `at` on of a text of id `ref`.
    """
    rows = keyed(docs, doc_id, text)
    with passing(docs.sparkSession):
        found = written(matches(rows, window, gram), "matches", lasting=True)
    made = rows.join(found, ["id", "tag"], "left").select("id", "text", "matches")
    name = "array<struct<start:long,n_words:long,ref:long,at:long>>"
    schema = f"doc_id long, text string, n_words long, n_removed long, kept_sha256 string, factors {name}"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref", pa.int64()), ("at", pa.int64())]))

    def batches(it):
        for batch in it:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                listed = part.column(2)
                flat = listed.flatten()
                count = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
                runs = extended({"doc": np.repeat(np.arange(len(part)), count)} | {k: flat.field(k).to_numpy() for k in ("start", "n", "ref", "tag", "at")})
                ends = np.searchsorted(runs["doc"], np.arange(len(part) + 1)).tolist()
                each = list(zip(*(runs[k].tolist() for k in ("start", "end", "ref", "shift")), strict=True))
                out = []
                for k, (number, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    spans = parse(each[ends[k] : ends[k + 1]], window)
                    n, kept = kept_words(t, spans)
                    whole = b" ".join(kept)
                    names = [{"start": a, "n_words": b, "ref": None if c == NO_ID else c, "at": d} for a, b, c, d in spans]
                    out.append((None if number == NO_ID else number, whole.decode(), n, n - len(kept), hashlib.sha256(whole).hexdigest(), names))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "factors"])

    return mapped(made, batches, schema)
