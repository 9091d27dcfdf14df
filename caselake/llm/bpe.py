"""Byte-level BPE with a public vocabulary: contiguous rank arrays, many short words at a time.

A word's parts and the ranks of its adjacent pairs stand in arrays. Again and again the smallest rank is found (the
leftmost of equals), the boundary under it deleted, and the ranks at its sides looked up anew. A batch's words that no
cache knows are rows of one matrix per length class, so each step is a numpy operation for all of them; a word of over
64 bytes is merged alone through a heap, since scanning is quadratic there.

Texts are split at single spaces first: unless white space comes before a space, what follows a space is pre-tokenised
alike wherever it stands, so its ids are kept by piece. A task keeps about CACHE_BYTES of pieces and words, none over KEPT_CHARS.

The vocabulary file (tokenizers' JSON, no normaliser, byte-level pre-tokeniser) is named by path and must lie at that
path on every worker. Defined results: a null text is an empty text and has no ids; a very long text is encoded whole,
alone in its slice; the strings of special tokens in a text are their ids, as the tokenizers library has it; an id outside
the vocabulary is an error on decoding; repeated rows get equal results each; an empty table gives an empty table; other
columns don't matter, but a column in `keep` with the name of a made one is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, text_bytes

SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: About the most bytes of a task's caches, ENTRY_BYTES for an entry's objects beside its content.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 130
KEPT_CHARS = 256
NEVER = np.iinfo(np.int32).max
CLASSES = (8, 16, 32, 64)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies (a public convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normaliser or prefix space are read")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.base = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.find = regex.compile(PATTERN).findall
        self.odd_space = regex.compile(rf"[{SPACES}] ").search
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Little-endian ids of each word; all have two to `width` bytes."""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.base[raw]
        ranks = np.full((n, width), NEVER, np.int32)
        pair = np.arange(width - 1) < (size - 1)[:, None]
        ranks[:, :-1][pair] = self.rank_of(parts[:, :-1][pair], parts[:, 1:][pair])
        out_parts, out_size = parts.copy(), size.copy()
        row = np.arange(n)
        column = np.arange(width)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            on = best < NEVER
            if not on.all():
                off = ~on
                out_parts[row[off]], out_size[row[off]] = parts[off], size[off]
                row, parts, ranks, size, at, best = row[on], parts[on], ranks[on], size[on], at[on], best[on]
                here = np.arange(len(row))
                if not len(row):
                    break
            parts[here, at] = self.merged[best]
            # the boundary after `at` goes: what stands behind it moves up
            source = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, axis=1)
            source = np.minimum(column + (column >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = NEVER
            size = size - 1
            ranks[here, at] = NEVER
            right = np.flatnonzero(at + 1 < size)
            ranks[right, at[right]] = self.rank_of(parts[right, at[right]], parts[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank_of(parts[left, at[left] - 1], parts[left, at[left]])
        flat = out_parts.astype("<u4")
        return [flat[k, :s].tobytes() for k, s in enumerate(out_size.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """One long word through a heap of (rank, place) and links to neighbours."""
        parts = self.base[np.frombuffer(word, np.uint8)]
        ranks = self.rank_of(parts[:-1], parts[1:])
        heap = [(int(r), k) for k, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        ids, after, before = parts.tolist(), list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        now = ranks.tolist() + [NEVER]
        one = lambda a, b: int(self.rank_of(np.array([ids[a]]), np.array([ids[b]]))[0])
        while heap:
            r, k = heapq.heappop(heap)
            if now[k] != r:
                continue
            gone = after[k]
            ids[k], now[gone] = int(self.merged[r]), NEVER
            ids[gone] = -1
            after[k] = nxt = after[gone]
            now[k] = NEVER
            if nxt < len(ids):
                before[nxt] = k
                now[k] = one(k, nxt)
                if now[k] != NEVER:
                    heapq.heappush(heap, (now[k], k))
            if (p := before[k]) >= 0:
                now[p] = one(p, k)
                if now[p] != NEVER:
                    heapq.heappush(heap, (now[p], p))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn_words(self, words: set[str]) -> None:
        """Put the ids of words that the cache lacks into it."""
        new = [w for w in words if w not in self.words]
        raw = [w.encode() for w in new]
        low = 0
        for width in CLASSES:
            at = [k for k, r in enumerate(raw) if max(low, 1) < len(r) <= width]
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                self.words.update(zip((new[k] for k in part), self.merge_rows([raw[k] for k in part], width), strict=True))
            low = width
        for w, r in zip(new, raw, strict=True):
            if len(r) == 1:
                self.words[w] = np.array([self.base[r[0]]], "<u4").tobytes()
            elif len(r) > CLASSES[-1]:
                self.words[w] = self.merge_long(r)
        self._count(self.words, new)

    def _count(self, cache: dict[str, bytes], new) -> None:
        """Add what is new in a cache to the size."""
        self.size += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(len(cache[k]) for k in new)

    def _drop(self, cache: dict[str, bytes], keys) -> None:
        for k in keys:
            self.size -= ENTRY_BYTES + len(k) + len(cache.pop(k))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.special and any(s in t for s in self.special for t in texts):
            return [self._with_special(t) for t in texts]
        split = [None if self.odd_space(t) else t.split(" ") for t in texts]
        whole = [self.find(t) if s is None else self.find(s[0]) for t, s in zip(texts, split, strict=True)]
        used = set(chain.from_iterable(s[1:] for s in split if s is not None))
        found = {p: self.find(" " + p) for p in used.difference(self.pieces)}
        self.learn_words(set(chain.from_iterable(found.values())).union(chain.from_iterable(whole)))
        word, piece = self.words.__getitem__, self.pieces
        piece.update((p, b"".join(map(word, w))) for p, w in found.items())
        self._count(piece, found)
        get = piece.__getitem__
        made = [b"".join(map(word, w)) if s is None else b"".join([*map(word, w), *map(get, s[1:])]) for w, s in zip(whole, split, strict=True)]
        if self.size > CACHE_BYTES:
            self.forget()
        else:
            self._drop(piece, [p for p in found if len(p) > KEPT_CHARS])
            self._drop(self.words, {w for ws in chain(found.values(), whole) for w in ws if len(w) > KEPT_CHARS})
        return made

    def forget(self) -> None:
        """Free the caches, so that an idle worker holds none."""
        self.words, self.pieces, self.size = {}, {}, 0

    def _with_special(self, text: str) -> bytes:
        parts = self.at_special(text)
        made = iter(self.encode([p for p in parts if p not in self.special]))
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else next(made) for p in parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _kept(df: DataFrame, keep: list[str], column: str, made: str) -> tuple[DataFrame, str]:
    clash = {c.lower() for c in keep} & {m.split()[0] for m in made.split(", ")}
    if clash:
        raise ValueError(f"kept columns have the names of made ones: {sorted(clash)}")
    kept = df.select(*keep, F.col(column).alias("__in"))
    return kept, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), made])


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), arrays: bool = True) -> DataFrame:
    """`keep` and ids: each whole text's token ids, as array<int> or (arrays=False) little-endian 32-bit binary."""
    kept, schema = _kept(df, list(keep), text, "ids array<int>" if arrays else "ids binary")

    def batches(it):
        bpe = load(path)
        for batch in it:
            column = batch.column(len(keep))
            _, offsets = text_bytes(column)
            for i, j in slices(offsets):
                ids = bpe.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                if arrays:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                else:
                    made = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), made], names=[*keep, "ids"])
        bpe.forget()

    return mapped(kept, batches, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the ids as little-endian 32-bit binary, and the text that they stand for (null for null)."""
    binary = df.schema[ids].dataType.typeName() == "binary"
    kept, schema = _kept(df, list(keep), ids, "ids binary, text string")

    def batches(it):
        bpe = load(path)
        for batch in it:
            column = batch.column(len(keep))
            for i in range(0, len(column), 512):
                part = column.slice(i, 512)
                raw = part.to_pylist() if binary else [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for v in part]
                texts = [None if r is None else bpe.decode(np.frombuffer(r, "<u4")) for r in raw]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 512) for c in batch.columns[: len(keep)]), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=[*keep, "ids", "text"])

    return mapped(kept, batches, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """`keep`, n_tokens, SHA-256 of the ids (little-endian 32-bit) and of the text that they decode to, and the ids.

    Encoding and decoding share a worker and its tables, so no worker is needed for each.
    """
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    kept, schema = _kept(df, list(keep), text, made)

    def batches(it):
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in it:
            column = batch.column(len(keep))
            _, offsets = text_bytes(column)
            for i, j in slices(offsets):
                ids = bpe.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                back = [bpe.decode(np.frombuffer(x, "<u4")).encode() for x in ids]
                arrays = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), *arrays], names=[*keep, *names])
        bpe.forget()

    return mapped(kept, batches, schema)
