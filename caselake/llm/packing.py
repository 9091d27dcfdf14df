"""Documents' token ids in as few sequences of at most `capacity` tokens as can be found, each document whole where it fits.

Martello and Toth's reduction: a set F of documents that holds document j dominates another set of j's if those others can
be dealt out among F's members so that each member is at least as long as its share. If F dominates every set that fits
beside j, some best packing has F as a sequence of its own: F is fixed, the instance shrinks, and the rule is applied again.
Looked at are sets of up to three, j being the longest document left:

* nothing fits beside j: {j};
* something fills j's sequence to the last token: {j, a};
* no two others fit beside j, or no two are longer together than the longest that fits, a: {j, a};
* no three others fit, and of each pair that fits the shorter is no longer than b, or both together no longer than a,
  where b is the longest beside j and a: {j, a, b}.

What no rule fixes is packed best fit, longest first.

Only lengths matter to all this, and there are at most `capacity` of them. So the plan is made on the driver from a count for
each length, however many documents there are: a rule or a best fit is applied to as many equal documents at once as it holds for
(removing documents never makes a dominating set lose its rank). The plan is ranges of ranks: the documents of a length
that are numbered from here to there go to these sequences, at this offset. Spark numbers the documents of a length: each task
counts its own, and a running sum over the tasks' counts places them.

Texts are encoded by the tokenizers library, whose ids a worker keeps by piece. Split at single spaces, a text's pieces
are pre-tokenised alike wherever they stand, unless white space comes before a space; such texts, and those that hold a
special token, are encoded whole. This holds for byte-level vocabularies without normaliser or prefix space; others are refused.

Defined results: a null text is an empty text and holds the end id alone; a null id is a value like others, of any type;
repeated rows are packed each; a document above the capacity is cut from its end, so its first piece may be shorter; a very
long text is encoded some ENCODE_CHARS at a time; an empty table gives an empty table; columns beside those named don't matter.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACES
from .common import mapped, slices, text_bytes, written

#: About the most bytes of pieces and their ids that a worker keeps, ENTRY_BYTES for each entry's objects beside its content.
CACHE_BYTES = 160 << 20
ENTRY_BYTES = 160
#: A piece above this is encoded each time anew.
KEPT_CHARS = 256
#: Of a long text, about so many characters are split and looked up together.
ENCODE_CHARS = 1 << 20


class PieceEncoder:
    """The library's ids for texts under a byte-level vocabulary, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, after, model = spec["pre_tokenizer"], spec.get("post_processor") or {"type": "ByteLevel"}, spec["model"]
        plain = spec["normalizer"] is None and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        if not plain or after["type"] != "ByteLevel" or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without normaliser or prefix space are encoded piece by piece")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        blanks = [chr(c) for c in range(0x3001) if regex.fullmatch(f"[{SPACES}]", chr(c))]
        self.odd = [*(c + " " for c in blanks), *(t["content"] for t in spec["added_tokens"])]
        self.blank_ends = frozenset(["", *blanks])
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece with a space before it; many pieces are one text, cut where a token begins with a space."""
        alone = [p for p in pieces if p[-1:] in self.blank_ends]  # they would run into the next piece's space
        joined = list(set(pieces).difference(alone))
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        found = dict(zip(alone, self.whole([" " + p for p in alone]), strict=True))
        for group, flat in zip(groups, self.whole([" " + " ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.begins[np.frombuffer(flat, "<u4")])
            if len(cuts) != len(group) or cuts[0]:
                raise ValueError("pieces can't be told apart")
            ends = [*(4 * cuts[1:]).tolist(), len(flat)]
            found.update(zip(group, (flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        return found

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        made = list(map(self.pieces.get, pieces))
        if None in made:
            new = {p for p, ids in zip(pieces, made, strict=True) if ids is None}
            found = self._after_space(list(new))
            made = [found[p] if ids is None else ids for p, ids in zip(pieces, made, strict=True)]
            if self.size > CACHE_BYTES:
                self.pieces, self.size = {}, 0
            kept = {p: ids for p, ids in found.items() if len(p) <= KEPT_CHARS}
            self.pieces.update(kept)
            self.size += ENTRY_BYTES * len(kept) + 2 * sum(map(len, kept)) + sum(map(len, kept.values()))
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. What the texts' pieces lack in the cache is encoded for all of them together."""
        out: list = [None] * len(texts)
        odd = [k for k, t in enumerate(texts) if any(x in t for x in self.odd)]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
            out[k] = ids
        plain = [k for k in range(len(texts)) if out[k] is None]
        heads, rests = [], []
        for k in plain:
            head, space, rest = texts[k].partition(" ")
            heads.append(head)
            rests.append(rest if space else None)
        for k, ids in zip(plain, self.whole(heads), strict=True):
            out[k] = ids
        batch, chars = [], 0
        for k, rest in zip(plain, rests, strict=True):
            if rest is None:
                continue
            if chars + len(rest) > ENCODE_CHARS:
                self._add(out, batch)
                batch, chars = [], 0
            batch.append((k, rest))
            chars += len(rest)
        self._add(out, batch)
        return out

    def _add(self, out: list, batch: list[tuple[int, str]]) -> None:
        """Put the ids of what follows each text's first space behind its first."""
        if len(batch) == 1 and len(batch[0][1]) > ENCODE_CHARS:
            k, rest = batch[0]
            parts, at = [out[k]], 0
            while at <= len(rest):
                end = rest.find(" ", at + ENCODE_CHARS)
                end = len(rest) if end < 0 else end
                parts += self._spaced(rest[at:end].split(" "))
                at = end + 1
            out[k] = b"".join(parts)
            return
        split = [rest.split(" ") for _, rest in batch]
        made, at = self._spaced(list(chain.from_iterable(split))), 0
        for (k, _), s in zip(batch, split, strict=True):
            out[k] = b"".join([out[k], *made[at : at + len(s)]])
            at += len(s)


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place) and, if asked for, the ids: place numbers a task's pieces of one length."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it):
        part, words, seen = TaskContext.get().partitionId(), encoder(path), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in it:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                of, made, ids = [], [], []
                for row, x in enumerate(words.encode(batch.column(1).slice(i, j - i).to_pylist()), i):
                    x = memoryview(x + end)
                    for k, (start, n) in enumerate(cut(len(x) // 4, capacity)):
                        seen[n] = seen.get(n, -1) + 1
                        one = x[4 * start : 4 * (start + n)]
                        of.append(row)
                        made.append((k, start, n, zlib.crc32(one), part, seen[n]))
                        if with_ids:
                            ids.append(bytes(one))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names=names)

    return mapped(rows, batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids)


def dominating(counts: np.ndarray, j: int) -> tuple[tuple[int, ...], int] | None:
    """A set that dominates every other one of a document of length j, the longest left, and how often it may be fixed."""
    room = len(counts) - 1 - j
    others = counts.copy()
    others[j] -= 1
    fit = np.flatnonzero(others[: room + 1])
    if not len(fit):
        return (j,), int(counts[j]) if j > room else 1
    a = int(fit[-1])

    def often(*members: int) -> int:
        return min(int(counts[x]) // members.count(x) for x in members)

    low = np.repeat(fit[:3], np.minimum(others[fit[:3]], 3))[:3]
    if a == room or low[:2].sum() > room or len(low) < 2:
        return (j, a), often(j, a)
    if len(low) == 3 and low.sum() <= room:
        return None
    # of each x, the longest y up to x that fits beside j and x
    at = np.searchsorted(fit, np.minimum(fit, room - fit), side="right") - 1
    at -= (at >= 0) & (fit[at] == fit) & (others[fit] < 2)
    x, y = fit[at >= 0], fit[at[at >= 0]]
    if not len(x) or a >= (x + y).max():
        return (j, a), often(j, a)
    if x[-1] == a and ((y <= y[-1]) | (x + y <= a)).all():
        return (j, a, int(y[-1])), often(j, a, int(y[-1]))
    return None


def reduced(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets that some best packing holds, with how often, and the counts that are left."""
    counts, fixed, again = counts.copy(), [], True
    while again:
        again = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (found := dominating(counts, j)):
                members, n = found
                for x in members:
                    counts[x] -= n
                fixed.append(found)
                again = True
    return fixed, counts


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of whole groups of sequences that are alike."""
    capacity = len(counts) - 1
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(members: tuple[int, ...], n: int, room: int) -> None:
        if n:
            by_room[room].append((members, n))
            filled[room] = True

    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            room = s + int(filled[s:].argmax())
            if filled[room]:
                members, n = by_room[room].pop()
                filled[room] = bool(by_room[room])
            else:
                members, n, room = (), left, capacity
            each = room // s  # a sequence that took one is still the tightest for the next
            full = min(n, left // each)
            put(members + (s,) * each, full, room - each * s)
            left -= full * each
            n -= full
            if n and left:  # fewer than one more sequence takes
                put(members + (s,) * left, 1, room - left * s)
                left, n = 0, n - 1
            if members:
                put(members, n, room)
    return [group for groups in by_room for group in groups]


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    capacity, size = len(counts) - 1, np.arange(len(counts))
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    best = 0
    for low in range(capacity // 2 + 1):
        high = capacity - low
        alone, large = number[-1] - number[high], number[high] - number[capacity // 2]
        small = total[capacity // 2] - (total[low - 1] if low else 0)
        spare = large * capacity - (total[high] - total[capacity // 2])
        best = max(best, int(alone + large + max(0, -(-(small - spare) // capacity))))
    return best


@dataclass(frozen=True)
class Plan:
    """Places of the documents of each length: from rank `first` on, `n` sequences from `sequence` on get one each at `offset`, then one more behind it."""

    capacity: int
    fixed: int
    sequences: int
    bound: int
    length: np.ndarray
    first: np.ndarray
    n: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank, length))
        start = np.searchsorted(self.length, length[order], side="left")
        end = np.searchsorted(self.length, length[order], side="right")
        at = np.empty(len(order), np.int64)
        for value in np.unique(length):  # ranges of one length are ascending
            rows = slice(*np.searchsorted(length[order], [value, value + 1]))
            a, b = start[rows][0], end[rows][0]
            at[rows] = a + np.searchsorted(self.first[a:b], rank[order[rows]], side="right") - 1
        slot = np.empty_like(at)
        slot[order] = at
        t = rank - self.first[slot]
        return self.sequence[slot] + t % self.n[slot], self.offset[slot] + t // self.n[slot] * length


def plan(counts: np.ndarray) -> Plan:
    """counts[s]: documents of length s; its last place is the capacity."""
    fixed, left = reduced(counts)
    groups = fixed + best_fit(left)
    taken = np.zeros(len(counts), np.int64)
    rows, base = [], 0
    for members, n in groups:
        offset = 0
        for s in sorted(set(members), reverse=True):
            k = members.count(s)
            rows.append((s, int(taken[s]), n, base, offset))
            taken[s] += k * n
            offset += k * s
        base += n
    if (taken != counts).any():
        raise AssertionError("the plan leaves documents out")
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(len(counts) - 1, sum(n for _, n in fixed), base, lower_bound(counts), *columns)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and its ids (little-endian 32-bit) if asked for."""
    made = written(pieces(docs, path, capacity, end_id, doc_id, text, with_ids), "packing-pieces", lasting=True)
    counted = written(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts", lasting=True)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("place") + F.col("base")).alias("rank"))
    found = plan(counts)

    def placed(it):
        for batch in it:
            at = batch.schema.get_field_index("rank")
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = found.places(length, batch.column(at).to_numpy())
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:at], "sequence_id", "offset"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]]
    return mapped(ranked, placed, ", ".join([*kinds, "sequence_id long, offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pack(with_ids=True): the ids of a sequence's pieces, one behind the other."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    joined = F.aggregate("held", F.lit(b"").cast("binary"), lambda all_, one: F.concat(all_, one["ids"]))
    return own.select("sequence_id", "n_tokens", joined.alias("ids"))
