"""Cheapest repair of conversations to an optional system turn and then user and assistant in turn, by run-length dynamic programming.

A row is a symbol: the initial of its role (s, u, a, another) and its first fault (blank, duplicate, truncated, none). A
symbol's effect on the four places where a repaired conversation can stand (at its start, after s, after u, after a) is
a 4 x 4 matrix of least costs under (min, +), insertions before the row included. Equal consecutive symbols are one run; what
a run of n rows costs from each place is the product of the matrix's binary powers for the bits of n, which are kept
for each symbol. From the costs at the ends of the runs the choices are unrolled, the ASCII-least edit first among
equally cheap ones: D(elete), I(nsert), K(eep), R(erole). They determine the repair.

Spark's part: equal rows of one turn are summed into one with a number of copies before anything moves, copies of a message
are found by joins of hashes, whose hot keys Spark can split, and a sort by range deals the symbols of a long conversation
over several tasks, so that only its runs meet. The audit has a character for each row, so one row of the result is as large
as the runs at most. The repaired text is hashed as a stream of rows sorted by conversation: SHA-256 has to see a
conversation's text in order, so a conversation passes through one task, which holds a batch of rows and the audit alone.

Defined results: a null role or text is one space; a null conversation id is one of its own; null turns come first, rows of
one turn by role, then by the SHA-256 of their texts (Spark's string order); an empty role has no initial; a conversation
all of whose rows are dropped has zeros, an empty audit and the hash of nothing; very long texts are hashed as others;
an empty table gives an empty table; columns beside those named don't matter, whatever their names. Turns are integers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: The place after an inserted or a new role, from each place.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of a run whose costs are held together while choices are unrolled.
UNROLLED = 1024

Matrix = tuple[tuple[int, ...], ...]


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): by CRC-32 of `conv_id:turn` a twentieth each is dropped, emptied, robbed of full stops, repeated, or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(code == 4, "user").otherwise(part(role)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(part(text), ".!?", "")).otherwise(part(text)).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def advance(state: int, role_class: int) -> int | None:
    """The place after a kept row of a class (0: s, 1: u, 2: a), if it may stand there."""
    if role_class == 0:
        return SYSTEM if state == START else None
    if role_class in (1, 2) and NEXT[state] == (USER, ASSISTANT)[role_class - 1]:
        return NEXT[state]
    return None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][k] + v[k] for k in range(4)) for i in range(4))


def _inserting() -> Matrix:
    """Costs between places by insertions alone."""
    rows = []
    for start in range(4):
        row, at = [NEVER] * 4, start
        for k in range(3):
            row[at] = min(row[at], INSERT * k)
            at = NEXT[at]
        rows.append(tuple(row))
    return tuple(rows)


INSERTING = _inserting()
#: Costs of the end: the places where a conversation may stop are the start and after the assistant.
ENDING = applied(INSERTING, (0, NEVER, NEVER, 0))


@functools.cache
def options(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next place) of a row's edits, ASCII-least first."""
    role_class, fault = divmod(symbol, 4)
    found = [("D", DELETE, state)]
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if (kept := advance(state, role_class)) is not None:
            found.append(("K", KEEP + more, kept))
        found.append(("R", REROLE + more, NEXT[state]))
    return tuple(found)


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The effect of 2**k rows of a symbol."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    rows = []
    for state in range(4):
        row = [NEVER] * 4
        for _, cost, to in options(symbol, state):
            row[to] = min(row[to], cost)
        rows.append(tuple(row))
    return times(INSERTING, tuple(rows))


def before(symbol: int, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from each place before n rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            costs = applied(power(symbol, k), costs)
        n >>= 1
        k += 1
    return costs


def repair(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Least cost and ASCII-least cheapest edits of runs (symbol, number of rows)."""
    behind = [ENDING]
    for symbol, n in reversed(runs):
        behind.append(before(symbol, n, behind[-1]))
    behind.reverse()
    state, audit = START, []
    for (symbol, n), end in zip(runs, behind[1:], strict=True):
        for first in range(0, n, UNROLLED):
            last = min(n, first + UNROLLED)
            costs = [before(symbol, n - last, end)]
            for _ in range(first, last):
                costs.append(applied(power(symbol, 0), costs[-1]))
            for here, after in zip(costs[:0:-1], costs[-2::-1], strict=True):
                while True:
                    deleting, *others = options(symbol, state)
                    inserted = ("I", INSERT + here[NEXT[state]] - after[NEXT[state]], NEXT[state])
                    edit, state = next((e, to) for e, cost, to in (deleting, inserted, *others) if cost + after[to] == here[state])
                    audit.append(edit)
                    if edit != "I":
                        break
    while ENDING[state]:
        audit.append("I")
        state = NEXT[state]
    return behind[0][START], "".join(audit)


def followed(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows, from (role, text) of the rows as they are."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[state]
        yield edit, role if edit == "K" else ROLES[state], text


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, copies, symbol) from distinct rows (conv_id, turn, role, key, text, copies); no symbol where there are no copies."""
    live = rows.where("copies > 0")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = live.groupBy("conv_id", "role", "key").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "key")), F.col("first.turn").alias("_turn")), "repair-repeated", lasting=True)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select("conv_id", "turn", "role", "key", "copies", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))
    later = F.col("_key").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("copies") > 0, role_class * 4 + fault)
    return narrow.join(again, same, "left").select("conv_id", "turn", "role", "key", "copies", symbol.alias("symbol"))


ORDER = ("turn", "role", "key")


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys))


PIECE = pa.struct([("part", pa.int32()), ("runs", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("low", pa.int64()), ("turns", pa.int64())])


def pieces(symbols: DataFrame) -> DataFrame:
    """(conv_id, part, runs, first, last, low, turns): what a task has of a conversation, its runs as pairs of 64-bit integers.

    first and last are the turns of its first and last row, low its least turn that is no null, turns the number of those.
    """
    kind = symbols.schema["conv_id"].dataType.simpleString()
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER)]
    dealt = _sorted(symbols.select("conv_id", "turn", "role", "key", "copies", "symbol").repartitionByRange(*keys), "conv_id", *ORDER)
    dealt = dealt.select("conv_id", F.col("turn").cast("long").alias("turn"), "copies", "symbol")
    names = ["conv_id", "part", *(f.name for f in PIECE if f.name != "part")]

    def cut(it):
        part, none = TaskContext.get().partitionId(), object()
        conv, runs, first, last, low, turns, out = none, [], None, None, None, 0, []

        def close():
            out.append((conv, part, np.array(runs, "<i8").tobytes(), first, last, low, turns))

        for batch in it:
            arrow = batch.schema.field(0).type
            for of, turn, copies, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is none or of != conv:
                    if conv is not none:
                        close()
                    conv, runs, first, last, low, turns = of, [], None, None, None, 0
                if not copies:
                    continue
                if turn is not None and (low is None or turn != last):
                    low, turns = turn if low is None else low, turns + 1
                first, last = turn if not runs else first, turn
                # all copies of a row but the first repeat it
                for s, n in ((symbol, 1), (symbol // 4 * 4 + (BLANK if symbol % 4 == BLANK else DUPLICATE), copies - 1)):
                    if n and runs and runs[-1][0] == s:
                        runs[-1][1] += n
                    elif n:
                        runs.append([s, n])
            if len(out) >= 4096:
                yield _batch(out, [arrow, *kinds], names)
                out.clear()
        if conv is not none:
            close()
            yield _batch(out, [arrow, *kinds], names)

    kinds = [f.type for f in PIECE]
    return mapped(dealt, cut, f"conv_id {kind}, part int, runs binary, first long, last long, low long, turns long")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@functools.lru_cache(4096)
def _remembered(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return repair(runs)


def judged(held: list[dict]) -> tuple[int, int, int, int, int, int, str]:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's pieces, in order."""
    runs: list[tuple[int, int]] = []
    low = high = None
    turns, faults, illegal, rows, last = 0, [0] * 4, 0, 0, None
    for piece in held:
        flat = np.frombuffer(piece["runs"], "<i8").tolist()
        for s, n in zip(flat[::2], flat[1::2], strict=True):
            if runs and runs[-1][0] == s:
                n += runs.pop()[1]
            runs.append((s, n))
        if piece["low"] is None:
            continue
        turns += piece["turns"] - (low is not None and piece["first"] == last)
        low = piece["low"] if low is None else low
        high = last = piece["last"]
    for k, (s, n) in enumerate(runs):
        faults[s % 4] += n
        pair = None if not k else (runs[k - 1][0] // 4, s // 4)
        illegal += n - 1 + (k > 0 and pair not in ((0, 1), (1, 2), (2, 1)))
    cost, audit = _remembered(tuple(runs)) if len(runs) <= 64 and sum(n for _, n in runs) <= 256 else repair(runs)
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, audit


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(symbols: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation. A task's piece is one value, so a
    conversation has as many as there are partitions at most."""
    kind = symbols.schema["conv_id"].dataType.simpleString()
    held = pieces(symbols).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*(f.name for f in PIECE)))).alias("held"))

    def solve(it):
        for batch in it:
            made = [judged(h) for h in batch.column(1).to_pylist()]
            if made:
                kinds = [*[pa.int64()] * len(FOUND), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True))], names=["conv_id", *FOUND, "audit"])

    return mapped(held, solve, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FOUND) + ", audit string")


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with their copies, and the audits, both as tables."""
    own = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.when(F.col("copies") > 0, F.coalesce("text", F.lit(" "))).otherwise("")})
    own = own.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    distinct = written(own.groupBy("conv_id", "turn", "role", "key").agg(F.first("text").alias("text"), F.sum("copies").alias("copies")), "repair-rows", lasting=True)
    symbols = written(marked(distinct), "repair-symbols", lasting=True)
    return distinct, written(audits(symbols), "repair-audits", lasting=True)


def _streamed(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of both, each conversation's audit first, then its rows in order."""
    none = lambda c: F.lit(None).cast(distinct.schema[c].dataType).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none("turn"), none("role"), none("key"), none("text"), F.lit(1).cast("long").alias("copies"), *FOUND, "audit")
    nothing = [F.lit(None).cast("long").alias(c) for c in FOUND]
    body = distinct.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text", "copies", *nothing, F.lit(None).cast("string").alias("audit"))
    dealt = _sorted(heads.unionByName(body).repartition("conv_id"), "conv_id", "kind", *ORDER)
    return dealt.select("conv_id", "role", "text", "copies", *FOUND, "audit")


def _conversations(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """The audit row of each conversation and the stream of its rows (role, text), repeated as often as they have copies."""
    flat = (row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(flat, None)

    def own():
        nonlocal ahead
        while ahead is not None and ahead[-1] is None:
            for _ in range(ahead[3]):
                yield ahead[1], ahead[2]
            ahead = next(flat, None)

    while ahead is not None:
        head = ahead
        ahead = next(flat, None)
        rows = own()
        yield head, rows
        for _ in rows:  # what the audit didn't ask for
            raise ValueError("an audit is shorter than its conversation")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) from (conv_id, turn, role, text, copies)."""
    stream = _streamed(*_prepared(rows.select("conv_id", "turn", "role", "text", "copies")))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def hashed(it):
        out, first = [], next(it, None)
        if first is None:
            return
        kinds, names = [first.schema.field(0).type, *[pa.int64()] * len(FOUND), pa.string(), pa.string()], ["conv_id", *FOUND, "audit", "repaired_sha256"]
        for head, own in _conversations(chain([first], it)):
            sha, between = hashlib.sha256(), b""
            for _, role, text in followed(head[-1], own):
                sha.update(b"%s%s:%s" % (between, role.encode(), text.encode()))
                between = b"\n"
            out.append((head[0], *head[4:], sha.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, kinds, names)
                out = []
        if out:
            yield _batch(out, kinds, names)

    return mapped(stream, hashed, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FOUND) + ", audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations themselves, from (conv_id, turn, role, text, copies)."""
    stream = _streamed(*_prepared(rows.select("conv_id", "turn", "role", "text", "copies")))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def told(it):
        out, size, first = [], 0, next(it, None)
        if first is None:
            return
        kinds, names = [first.schema.field(0).type, pa.int64(), *[pa.string()] * 3], ["conv_id", "place", "edit", "role", "text"]
        for head, own in _conversations(chain([first], it)):
            for place, (edit, role, text) in enumerate(followed(head[-1], own)):
                out.append((head[0], place, edit, role, text))
                size += len(text) + 64
                if size >= 1 << 20:
                    yield _batch(out, kinds, names)
                    out, size = [], 0
        if out:
            yield _batch(out, kinds, names)

    return mapped(stream, told, f"conv_id {kind}, place long, edit string, role string, text string")
