"""Quality rules: lines that stand in too many documents of a host are removed, and documents left depleted are rejected.

One pass over the texts makes each document's base statistics and the hashes of its normalised lines (lower case,
white space collapsed). Lines are then counted by distinct document per host; equal texts count as one document, since
copies are the business of de-duplication. A line goes where its count is above `LineLimits.least` and above
`LineLimits.share` of the host's documents. A document is rejected when fewer than `LineLimits.left` of its words stay.
Lines are told apart by 64-bit hashes: of 10**11 lines, one is taken for one of 10**6 frequent ones with a chance of 0.5 %.

Defined results: a null text is an empty text; a null host is a host of its own; a line counts once a document, and goes
each time it stands there; a count or share equal to its limit stays; very long texts are judged whole; repeated rows each
get the same verdict; an empty table gives an empty table; columns beside those named are kept by `clean` and ignored
elsewhere, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, free_name, mapped, per_text, phrase_hashes, slices, text_bytes, whole_phrases, word_hashes, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class LineLimits:
    least: int = 3  # documents of a host that may share a line in any case
    share: float = 0.02  # of the host's documents that may share a line
    left: float = 0.75  # of a document's words that must stay
    min_words: int = 50
    max_repeat_pct: int = 50


PROFILE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:long>>"


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(line.lower().split())) - (1 << 63)


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text inside a three-word window that occurs twice or more in that text."""
    at = whole_phrases(words, 3)
    covered = np.zeros(len(words.start), bool)
    if len(at):
        key = phrase_hashes(word_hashes(words)[:1], 3)[0, at]
        text = words.text_of_word()[at]
        order = np.lexsort((key, text))
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] = same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            covered[hit + k] = True
    return per_text(covered, words.first)


def _profiles(texts: pa.Array) -> dict[str, list]:
    data, offsets = text_bytes(texts)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines")}
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        places = offsets[i : j + 1] - offsets[i]
        words = Words(part, places)
        out["n_words"] += words.counts.tolist()
        out["word_chars"] += per_text(((part & 0xC0) != 0x80) & ~SPACE[part], places).tolist()
        out["n_symbols"] += per_text(SYMBOLS[part], places).tolist()
        out["n_repeat_words"] += repeated_words(words).tolist()
        whole = part.tobytes()
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            raw = whole[a:b]
            seen: set[bytes] = set()
            again, lines = 0, {}
            for line in raw.split(b"\n"):
                if n := len(line.split()):
                    again += line in seen
                    seen.add(line)
                    h = line_hash(line.decode())
                    lines[h] = lines.get(h, 0) + n
            out["n_dup_lines"].append(again)
            out["lines"].append([{"h": h, "n": n} for h, n in lines.items()])
    return out


def text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def profiles(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep`, text_hash and the statistics of each row's whole text (see PROFILE), with n words for each distinct line h."""
    kept = docs.select(*keep, text_hash(text).alias("text_hash"), F.col(text).alias("__text"))
    keep = [*keep, "text_hash"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), PROFILE])
    kinds = {"lines": pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))}

    def batches(it):
        for batch in it:
            made = _profiles(batch.column(len(keep)))
            arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *made])

    return mapped(kept, batches, schema)


def line_counts(profiled: DataFrame, host: str) -> DataFrame:
    """(host, h, n_docs): distinct documents of a host with the line."""
    return profiled.select(host, "text_hash", F.explode("lines.h").alias("h")).groupBy(host, "h").agg(F.countDistinct("text_hash").alias("n_docs"))


def frequent_lines(profiled: DataFrame, host: str, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, h) of the lines to be removed."""
    hosts = profiled.groupBy(host).agg(F.countDistinct("text_hash").alias("__docs"))
    often = line_counts(profiled, host).where(F.col("n_docs") > limits.least)
    both = often.alias("a").join(hosts.alias("b"), F.col(f"a.{host}").eqNullSafe(F.col(f"b.{host}")))
    return both.where(F.col("n_docs") > limits.share * F.col("__docs")).select(f"a.{host}", "h", "n_docs")


def judged(profiled: DataFrame, doc_id: str, host: str, limits: LineLimits = LineLimits()) -> DataFrame:
    """profiled without `lines`, plus frequent (hashes of the lines to be removed), n_frequent_words, base_failed, kept.

    Only ids and hashes move: each document's lines meet the frequent lines of its host, and the hits return by document.
    """
    bad = frequent_lines(profiled, host, limits).withColumnRenamed(host, "__host")
    lines = profiled.select(doc_id, host, "text_hash", F.explode("lines").alias("l")).select(doc_id, host, "text_hash", "l.h", "l.n")
    hits = lines.join(bad.select("__host", "h"), ["h"]).where(F.col(host).eqNullSafe(F.col("__host")))
    # repeated rows have the same hits, which the set keeps once
    hits = hits.groupBy(doc_id, host, "text_hash").agg(F.collect_set(F.struct("h", "n")).alias("__hits"))
    a, b = profiled.drop("lines").alias("a"), hits.alias("b")
    same = F.col(f"a.{doc_id}").eqNullSafe(F.col(f"b.{doc_id}")) & F.col(f"a.{host}").eqNullSafe(F.col(f"b.{host}")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    joined = a.join(b, same, "left").select("a.*", "b.__hits")
    lost = F.coalesce(F.aggregate("__hits", F.lit(0).cast("long"), lambda s, x: s + x.n), F.lit(0))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))
    return (
        joined.withColumn("frequent", F.coalesce(F.col("__hits.h"), F.array().cast("array<bigint>")))
        .withColumn("n_frequent_words", lost)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("n_frequent_words") >= limits.left * F.col("n_words")))
        .drop("__hits")
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """docs without the rejected rows, and the kept rows' texts without frequent lines. All columns stay."""
    profiled = written(profiles(docs, text, [doc_id, host]), "quality-profiles")
    verdict = judged(profiled, doc_id, host, limits)
    mark = {c: free_name(docs, f"__{c}") for c in ("hash", "id", "host", "drop")}
    # one row for each distinct (id, host, text), so that repeated rows don't multiply
    change = verdict.where(F.col("kept")).groupBy(F.col(doc_id).alias(mark["id"]), F.col(host).alias(mark["host"]), F.col("text_hash").alias(mark["hash"])).agg(F.first("frequent").alias(mark["drop"]))
    key = free_name(docs, "__key")
    hashed = docs.withColumn(key, text_hash(text))
    joined = hashed.join(change, hashed[doc_id].eqNullSafe(change[mark["id"]]) & hashed[host].eqNullSafe(change[mark["host"]]) & (hashed[key] == change[mark["hash"]]))
    fresh = F.when(F.size(mark["drop"]) > 0, _without_udf()(F.col(text), F.col(mark["drop"]))).otherwise(F.col(text))
    return joined.withColumn(text, fresh).select(*docs.columns)


def _without_udf():
    @F.pandas_udf("string")
    def without(texts, drops):
        import pandas as pd

        def one(text, drop):
            gone = set(drop)
            return "\n".join(line for line in text.split("\n") if not line.split() or line_hash(line) not in gone)

        return pd.Series([t if not t or d is None or not len(d) else one(t, d) for t, d in zip(texts, drops, strict=True)], dtype=object)

    return without
