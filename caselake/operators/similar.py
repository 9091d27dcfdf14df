"""Related cases for the cases of a stated query set: by rules and by vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Similarity
from ..sources.shared import written
from .embed import case_centroids
from .vectors import CELLS, Top, Wanted, matrix, query_blocks, rounded

MOST = 20
#: Signatures that are compared together.
BLOCK = 2048


def case_profiles(cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """cases with their rule summaries, where they have one."""
    return cases.join(summaries, "case_id", "left")


def term_bits(text: Column, rules: Similarity = Similarity()) -> Column:
    """A bit for each lexicon term that the text holds (at most 63 terms)."""
    if len(rules.lexicon) > 63:
        raise ValueError("a lexicon has at most 63 terms")
    bits = [F.when(F.contains(text, F.lit(t)), F.lit(1 << k)).otherwise(0).cast("long") for k, t in enumerate(rules.lexicon)]
    total = F.lit(0).cast("long")
    for b in bits:
        total = total + b
    return total


def shared_terms(a: Column, b: Column, rules: Similarity = Similarity(), most: int = 5) -> Column:
    """The first of both bitmaps' common terms in code-point order."""
    order = sorted(range(len(rules.lexicon)), key=lambda k: rules.lexicon[k])
    each = [F.when(a.bitwiseAND(b).bitwiseAND(F.lit(1 << k)) != 0, F.lit(rules.lexicon[k])) for k in order]
    return F.slice(F.array_compact(F.array(*each)), 1, most)


def signatures(profiles: DataFrame, text: Column, rules: Similarity = Similarity()) -> DataFrame:
    """case_id, date, number, and what the rules look at: type, result, category (null if empty) and term bits."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    return profiles.select("case_id", "case_number", "decision_date", part("dispute_type").alias("type"), part("decision_result").alias("result"), part("decision_category").alias("category"), term_bits(text, rules).alias("bits"))


SIGNATURE = ["type", "result", "category", "bits"]


CODES = [f"{c}_code" for c in SIGNATURE]
KNOWN = [f"{c}_known" for c in SIGNATURE[:3]]
#: So many copies of a block of signatures at most meet the blocks that it has to see, each a share of them.
SALTS = 32


def _coded(signed: DataFrame) -> DataFrame:
    codes = [F.xxhash64(c).alias(f"{c}_code") if c != "bits" else F.col("bits").alias("bits_code") for c in SIGNATURE]
    known = [F.col(c).isNotNull().alias(f"{c}_known") for c in SIGNATURE[:3]]
    return signed.select("case_id", "case_number", "decision_date", *codes, *known).withColumn("sig", F.xxhash64(*CODES, *KNOWN))


def _members(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` cases of each signature; a signature's cases are ranked in shares first, so that none is sorted by one task."""
    by = [F.desc_nulls_last("decision_date"), F.desc_nulls_last("case_number"), F.col("case_id")]
    some = rows.withColumn("share", F.pmod(F.hash("case_id"), F.lit(64)))
    for keys in (["sig", "share"], ["sig"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("place") <= most)
    return some.drop("share", "place")


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left, right): every block of a key's rows on the left with every block of the key's on the right, as arrays of about BLOCK rows.

    A block of the right goes to one of the copies of each block on the left, so a hot key is as many tasks as it has blocks.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias(f"n_{name}"))
        part = F.pmod(F.xxhash64(*values), F.col(f"n_{name}")).alias(f"{name}_part")
        return df.join(n, keys).select(*keys, f"n_{name}", part, F.struct(*values).alias("v")).groupBy(*keys, f"n_{name}", f"{name}_part").agg(F.collect_list("v").alias(name))

    to = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    a, b = blocks(left, "left"), blocks(right, "right")
    a = a.join(right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("n")), keys).withColumn("salt", F.explode(to(F.least("n", F.lit(SALTS))))).drop("n_left", "n")
    b = b.join(left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("n")), keys).withColumn("left_part", F.explode(to(F.col("n")))).withColumn("salt", F.pmod("right_part", F.least("n_right", F.lit(SALTS))))
    return a.join(b.drop("n", "n_right", "right_part"), [*keys, "left_part", "salt"]).select("left", "right")


def _block_pairs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The pairs of blocks of a batch of _met, without an object for a row."""
    for k in range(len(batch)):
        yield tuple(pa.Table.from_struct_array(batch.column(name)[k].values) for name in ("left", "right"))


def _steps(left: int, right: int) -> Iterator[slice]:
    """Rows of a block on the left that are compared with a block on the right at once, CELLS pairs or so."""
    step = max(1, CELLS // max(1, right))
    return (slice(i, i + step) for i in range(0, left, step))


def _unrelated(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(sig, unrelated): how many cases share neither type, result, category nor a term with a signature.

    Counted by inclusion and exclusion over the equal features: for a set of them, cases that have all of these and no
    common term. So bitmaps are compared with bitmaps, once for each set of features, however many cases have them.
    """
    sets = [[c for k, c in enumerate(SIGNATURE[:3]) if m >> k & 1] for m in range(8)]
    entry = lambda m, cs: F.when(reduce(lambda x, y: x & y, [F.col(f"{c}_known") for c in cs], F.lit(True)), F.struct(F.xxhash64(F.lit(m), *(f"{c}_code" for c in cs)).alias("key"), F.lit((-1) ** len(cs)).alias("sign")))
    spread = lambda df: df.withColumn("e", F.explode(F.array_compact(F.array(*(entry(m, cs) for m, cs in enumerate(sets)))))).select("*", "e.key", "e.sign")
    held = spread(rows.groupBy("sig", *CODES, *KNOWN).agg(F.count(F.lit(1)).alias("n"))).groupBy("key", F.col("bits_code").alias("bits")).agg(F.sum("n").alias("n"))
    wanted = written(spread(asked).select("sig", "key", "sign", F.col("bits_code").alias("bits")), "asked-sets")

    def apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in _block_pairs(batch):
                bits, other, n = a["bits"].to_numpy(), b["bits"].to_numpy(), b["n"].to_numpy()
                found = [(np.bitwise_and.outer(bits[some], other) == 0) @ n for some in _steps(len(a), len(b))]
                yield pa.RecordBatch.from_pydict({"key": a["of"].combine_chunks(), "bits": bits, "n": np.concatenate(found)})

    left = wanted.select("key", F.col("key").alias("of"), "bits").distinct()
    found = _met(left, held, ["key"]).mapInArrow(apart, "key long, bits long, n long").groupBy("key", "bits").agg(F.sum("n").alias("n"))
    return wanted.join(found, ["key", "bits"], "left").groupBy("sig").agg(F.sum(F.col("sign") * F.coalesce("n", F.lit(0))).alias("unrelated"))


def similar_cases_topk(signed: DataFrame, sources: DataFrame | None = None, limit: int = 5, rules: Similarity = Similarity()) -> DataFrame:
    """(case_id, rank, similar_id, score, reasons, total_candidates) of each of the sources (case_id), or of all cases.

    The order is score, date and number, all descending, then id. Cases alike in type, result, category and terms are one
    signature, of which limit + 1 candidates at most are needed. A common type counts more than everything else together, so
    signatures of a type are compared with those of the type alone, unless it has too few cases; then with all others as well.
    """
    limit = min(max(limit, 1), MOST)
    if rules.same_type <= rules.same_result + rules.same_category + rules.most_terms:
        raise ValueError("a common type must count more than everything else together")
    rows = written(_coded(signed), "signatures")
    asked = rows if sources is None else rows.join(sources.select("case_id"), "case_id", "left_semi")
    packed = ["sig", *CODES, *KNOWN]
    members = written(_members(rows, limit + 1).select(*packed, "case_id", "decision_date", "case_number"), "members")
    sizes = rows.where("type_known").groupBy("type_code").agg(F.count(F.lit(1)).alias("size"))
    wanted = written(asked.select(*packed).distinct().join(sizes, "type_code", "left").withColumn("few", ~F.col("type_known") | (F.col("size") <= limit)), "wanted")
    case = signed.schema["case_id"].dataType.simpleString()

    def best(elsewhere: bool):
        def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for a, b in _block_pairs(batch):
                    place = pc.sort_indices(b, sort_keys=[("decision_date", "descending"), ("case_number", "descending"), ("case_id", "ascending")], null_placement="at_end")
                    b = b.take(place).combine_chunks()
                    left, right = ({c: t[c].to_numpy() for c in [*CODES, *KNOWN]} for t in (a, b))
                    for part in _steps(len(a), len(b)):
                        common = np.bitwise_and.outer(left["bits_code"][part], right["bits_code"])
                        score = np.minimum(np.bitwise_count(common).astype(np.int64) * rules.per_term, rules.most_terms)
                        same = {}
                        for c, w in zip(SIGNATURE[:3], (rules.same_type, rules.same_result, rules.same_category), strict=True):
                            both = np.logical_and.outer(left[f"{c}_known"][part], right[f"{c}_known"])
                            same[c] = both & np.equal.outer(left[f"{c}_code"][part], right[f"{c}_code"])
                            score += w * same[c]
                        if elsewhere:
                            score[same["type"]] = 0  # they have been compared
                        order = score * len(b) - np.arange(len(b))  # among equal scores the first candidate
                        k = min(limit + 1, len(b))
                        flat = np.argpartition(-order, k - 1, axis=1)[:, :k].ravel()
                        row = np.repeat(np.arange(len(order)), k)
                        some = score[row, flat] > 0
                        row, flat = row[some], flat[some]
                        found = b.select(["case_id", "decision_date", "case_number"]).take(pa.array(flat)).combine_chunks()
                        made = {"sig": a["sig"].to_numpy()[part][row], "similar_id": found["case_id"], "decision_date": found["decision_date"], "case_number": found["case_number"], "score": score[row, flat], "common": common[row, flat]}
                        yield from pa.table(made | {f"same_{c}": same[c][row, flat] for c in SIGNATURE[:3]}).to_batches()

        return rank

    schema = f"sig long, similar_id {case}, decision_date string, case_number string, score long, common long, same_type boolean, same_result boolean, same_category boolean"
    typed = lambda df: df.where("type_known").withColumn("of_type", F.col("type_code"))
    own = _met(typed(wanted.drop("size", "few")), typed(members), ["of_type"]).mapInArrow(best(False), schema)
    every = lambda df: df.withColumn("all", F.lit(0))
    rest = _met(every(wanted.where("few").drop("size", "few")), every(members), ["all"]).mapInArrow(best(True), schema)
    order = Window.partitionBy("sig").orderBy(F.desc("score"), F.desc_nulls_last("decision_date"), F.desc_nulls_last("case_number"), "similar_id")
    ranked = own.unionByName(rest).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    total = rows.count()
    counted = _unrelated(rows, asked.select(*packed).distinct()).select("sig", (F.lit(total) - F.col("unrelated") - 1).alias("total_candidates"))
    terms = shared_terms(F.col("common"), F.col("common"), rules)
    reasons = F.array_compact(F.array(*(F.when(F.col(f"same_{c}"), F.lit(f"same_{c}")) for c in SIGNATURE[:3]), F.when(F.size(terms) > 0, F.concat(F.lit("terms:"), F.array_join(terms, ",")))))
    # a signature's list is an array, so that its many cases are rows of one join
    lists = ranked.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("place", "similar_id", F.col("score").cast("double").alias("score"), reasons.alias("reasons")))).alias("found")).join(counted, "sig")
    each = asked.select("case_id", "sig").join(written(lists, "related"), "sig")
    others = F.slice(F.filter("found", lambda x: x["similar_id"] != F.col("case_id")), 1, limit)
    # the case itself has a score with itself wherever it has any feature, and then it was counted
    return each.select("case_id", "total_candidates", F.posexplode(others).alias("at", "x")).select("case_id", (F.col("at") + 1).alias("rank"), "x.similar_id", "x.score", "x.reasons", "total_candidates")


def similar_quality(similar: DataFrame, cases: DataFrame, sources: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row: how often the first and the first k related cases have the own type of each of the sources (case_id), or of all cases."""
    types = cases.select("case_id", "dispute_type")
    others = types.select(F.col("case_id").alias("similar_id"), F.col("dispute_type").alias("other_type"))
    hits = similar.where(F.col("rank") <= k).join(others, "similar_id").join(types, "case_id").withColumn("same", (F.col("dispute_type") == F.col("other_type")).cast("int"))
    per = hits.groupBy("case_id").agg(F.sum("same").alias("same"), F.max(F.when(F.col("rank") == 1, F.col("same"))).alias("first"))
    wanted = types if sources is None else types.join(sources.select("case_id"), "case_id", "left_semi")
    every = wanted.join(per, "case_id", "left").na.fill(0, ["same", "first"])
    return every.agg(
        F.count(F.lit(1)).alias("cases"), F.sum("first").alias("top1_same_type"), F.round(F.avg("first"), 4).alias("top1_rate"),
        F.sum((F.col("same") > 0).cast("int")).alias("topk_has_same_type"), F.round(F.avg("same"), 4).alias("avg_same_in_topk"), F.min("same").alias("min_same_in_topk"),
    )


def _segments(batch: pa.Table, q: np.ndarray, own: dict, of: np.ndarray, per: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For queries `of` against a batch sorted by case: (queries, first row of each case, the best `per` rounded scores of each case,
    their rows), the last two by query, case and place; -inf where there is none. A query's own case has none."""
    cases = batch["case_id"].combine_chunks().dictionary_encode()
    code = cases.indices.to_numpy()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    self_of = np.array([own.get(c, -1) for c in cases.dictionary.take(pa.array(code[first])).to_pylist()])
    x, n = matrix(batch["vector"].combine_chunks()), len(batch)
    step = max(1, CELLS // n)
    for i in range(0, len(of), step):
        some = of[i : i + step]
        score = q[some] @ x.T
        shown = np.where(score > least, rounded(score.ravel(), 4).reshape(score.shape), -np.inf)
        for k in np.flatnonzero(np.isin(self_of, some)).tolist():
            shown[self_of[k] - some[0], first[k] : first[k + 1] if k + 1 < len(first) else n] = -np.inf
        found, rows = [], []
        at = np.arange(len(some))[:, None]
        for _ in range(per):
            best = np.maximum.reduceat(shown, first, axis=1)
            hit = np.where(shown == np.repeat(best, np.diff(np.append(first, n)), axis=1), np.arange(n), n)
            row = np.minimum.reduceat(hit, first, axis=1)  # of equals the first, rows being in the order of chunks
            found.append(best)
            rows.append(row)
            shown[at, row] = -np.inf
        yield some, first, np.stack(found, axis=2), np.stack(rows, axis=2)


def _case_matches(keys: pa.Array, q: np.ndarray, items: DataFrame, q_type: str, limit: int, per: int, least: float) -> DataFrame:
    """(query_id, case_id, r, chunk_index, chunk_id, shown, total, whole) of a block of queries.

    items are sorted by case in each partition. A case that lies within a batch is ranked there, and a task keeps each query's first
    `limit` of them and how many have a chunk above `least` (rows without a case). A case that a batch begins or ends with may go on
    elsewhere, so its best chunks come from every batch (not `whole`) and are put together afterwards.
    """
    sent = items.sparkSession.sparkContext.broadcast((keys, q))
    case, chunk = items.schema["case_id"].dataType.simpleString(), items.schema["chunk_id"].dataType.simpleString()
    wanted = Wanted(limit, None, 4, False, (("decision_date", False), ("case_number", False), ("case_id", True)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = sent.value
        own = {k: i for i, k in enumerate(keys.to_pylist())}
        top, total, everyone = Top(len(q), wanted), np.zeros(len(q), np.int64), np.arange(len(q))
        case_kind = chunk_kind = None

        def out(query, cases, r, index, chunks, shown, totals, whole):
            columns = [keys.take(pa.array(query)), cases, pa.array(r, pa.int32()), index, chunks, pa.array(shown), pa.array(totals, pa.int64()), pa.array(np.full(len(query), whole))]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "case_id", "r", "chunk_index", "chunk_id", "shown", "total", "whole"])

        for raw in it:
            if not len(raw):
                continue
            batch = pa.Table.from_batches([raw])
            case_kind, chunk_kind = batch.schema.field("case_id").type, batch.schema.field("chunk_id").type
            column = lambda name: batch[name].combine_chunks()  # noqa: B023, E731
            for some, first, shown, rows in _segments(batch, q, own, everyone, per, least):
                last = len(first) - 1
                for k in {0, last}:
                    a, r = np.nonzero(np.isfinite(shown[:, k]))
                    at = pa.array(rows[a, k, r])
                    yield out(some[a], column("case_id").take(at), r + 1, column("chunk_index").take(at), column("chunk_id").take(at), shown[a, k, r], np.zeros(len(a)), False)
                inner = shown[:, 1:last, 0]
                total[some] += np.isfinite(inner).sum(axis=1)
                a, c = np.nonzero(np.isfinite(inner) & (inner >= top.floor[some][:, None]))
                c = c + 1
                kept = batch.select(["case_id", "decision_date", "case_number"]).take(pa.array(first[c]))
                for j in range(per):
                    has = np.isfinite(shown[a, c, j])
                    at = pa.array(np.where(has, rows[a, c, j], 0), mask=~has)
                    kept = kept.append_column(f"index{j}", column("chunk_index").take(at)).append_column(f"chunk{j}", column("chunk_id").take(at)).append_column(f"shown{j}", pa.array(shown[a, c, j]))
                top.add(kept, some[a], shown[a, c, 0])
        if case_kind is None:
            return
        top.sort()
        for t in top.held:
            for j in range(per):
                own_rows = t.filter(pc.is_valid(t[f"chunk{j}"]))
                n = len(own_rows)
                yield out(own_rows["_q"].to_numpy(), own_rows["case_id"].combine_chunks(), np.full(n, j + 1), own_rows[f"index{j}"].combine_chunks(), own_rows[f"chunk{j}"].combine_chunks(), own_rows[f"shown{j}"].to_numpy(), np.zeros(n), True)
        n = len(q)
        yield out(everyone, pa.nulls(n, case_kind), np.zeros(n), pa.nulls(n, batch.schema.field("chunk_index").type), pa.nulls(n, chunk_kind), np.zeros(n), total, True)

    index = items.schema["chunk_index"].dataType.simpleString()
    return items.mapInArrow(batches, f"query_id {q_type}, case_id {case}, r int, chunk_index {index}, chunk_id {chunk}, shown double, total long, whole boolean")


def semantic_similar(embeddings: DataFrame, cases: DataFrame, sources: DataFrame, limit: int = 5, chunks_per_case: int = 2, least: float = 0.0) -> DataFrame:
    """(case_id, rank, similar_id, similarity, chunk_ids, total): directed, a case's centroid against others' chunks.

    The chunks are sorted by case, once and by range, so that a case with many of them lies in several partitions; blocks of
    centroids meet every batch of them. sources (case_id) are the cases that are asked for. embeddings: chunk_id, case_id,
    chunk_index, vector; chunks of cases that aren't in `cases` don't count.
    """
    limit, per = min(max(limit, 1), MOST), min(max(chunks_per_case, 1), 5)
    named = cases.select("case_id", "decision_date", "case_number")
    known = embeddings.drop("decision_date", "case_number").where("vector is not null").join(named, "case_id")
    own = embeddings.join(sources.select("case_id"), "case_id", "left_semi")
    centroids = case_centroids(own).select(F.col("case_id").alias("query_id"), F.col("centroid").alias("vector"))
    q_type = centroids.schema["query_id"].dataType.simpleString()
    order = ["case_id", "chunk_index", "chunk_id"]
    items = written(known.select(*order, "decision_date", "case_number", "vector").repartitionByRange(*order).sortWithinPartitions(*order), "chunks-by-case")
    parts = [_case_matches(keys, q, items, q_type, limit, per, least) for keys, q in query_blocks(centroids, "query_id", "vector")]
    if not parts:
        return centroids.select(F.col("query_id").alias("case_id"), F.lit(0).alias("rank"), F.col("query_id").alias("similar_id"), F.lit(0.0).alias("similarity"), F.array(F.lit(None).cast(items.schema["chunk_id"].dataType)).alias("chunk_ids"), F.lit(0).cast("long").alias("total")).limit(0)
    found = written(reduce(DataFrame.unionByName, parts), "case-matches")
    split = found.where("not whole").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "case_id").orderBy(F.desc("shown"), "chunk_index", "chunk_id"))).where(F.col("r") <= per)
    kept = found.where("whole and case_id is not null").unionByName(split)
    grouped = kept.groupBy("query_id", "case_id").agg(F.max("shown").alias("similarity"), F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda s: s.chunk_id).alias("chunk_ids"))
    totals = found.where("case_id is null").groupBy("query_id").agg(F.sum("total").alias("total")).unionByName(split.where("r = 1").groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))).groupBy("query_id").agg(F.sum("total").alias("total"))
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("decision_date"), F.desc("case_number"), "case_id")
    ranked = grouped.join(named, "case_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).join(totals, "query_id")
    return ranked.select(F.col("query_id").alias("case_id"), "rank", F.col("case_id").alias("similar_id"), "similarity", "chunk_ids", "total")
