"""Cheapest repair of the turn structure of conversations by a rank-convergence parallel Viterbi.

Rows are sorted by range over the whole table, so a conversation of any length is cut into chunks that many tasks
hold.  The Viterbi runs backwards over four states (nothing written, after a system turn, after a user turn, after
an assistant turn).  Its cost vectors matter up to a constant only, and up to constants few are possible: a chunk
starts from all of them at once, and those that become parallel go on as one.  A chunk whose vectors have all become
parallel is settled whatever follows it.  Fix-up passes run the others again from what the chunk to the right
says, over twice the distance each time, until their vectors differ only by constants or the end is
reached.  With the vectors at all chunk ends known, each chunk is traced from every state, the states are stitched in the same way
from the left, and a last pass writes the edits.

Rows and results.  Null role or text is one space.  Rows of a conversation are taken by turn (nulls first), rows of
one turn by role and then by the md5 of the text, so any input order gives the same result.  A null ``conv_id`` is a
conversation.  Only the four columns named are read: other columns may have any name.  Empty tables give no rows.
Identical rows are counted before they are moved, so a row repeated a billion times is one row here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.llm.shared import WORD
from caseloom.operators.ordering import null_safe_join
from caseloom.session import cut_lineage

#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ENDS_SENTENCE = r"[.!?][\x20\x09-\x0D]*\z"
#: Bounds of a chunk: rows that may stay, and characters of their texts.
CHUNK_ROWS = 4096
CHUNK_CHARS = 8 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_INITIALS = "sua-"
LEGAL = {"su", "ua", "au"}
#: Row codes: twice the place of the initial in _INITIALS, one more for a truncated row; GONE must be deleted.
GONE = 8
_FAR = 1 << 40


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with insertions allowed at this place; a third one in a row never pays."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _row_costs(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Cost vector before a row from the one after it."""
    out = []
    for state, cost in enumerate(after):
        best = DELETE + cost
        if code != GONE:
            extra = TRUNCATED if code % 2 else 0
            kept = _KEPT.get((state, _INITIALS[code // 2]))
            best = min(best, REROLE + extra + after[_NEXT[state]], _FAR if kept is None else KEEP + extra + after[kept])
        out.append(best)
    return _closed(out)


@lru_cache(maxsize=1)
def vectors() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All cost vectors up to constants, the one of the end first, and the vector before a row for (vector, code)."""
    found = [_closed([0, _FAR, _FAR, 0])]
    steps: list[list[int]] = []
    place = {found[0]: 0}
    while len(steps) < len(found):
        row = []
        for code in range(GONE + 1):
            before = _row_costs(found[len(steps)], code)
            before = tuple(c - min(before) for c in before)
            if before not in place:
                place[before] = len(found)
                found.append(before)
            row.append(place[before])
        steps.append(row)
    return found, steps


def speculate(codes: bytes) -> list[int]:
    """For each cost vector after a chunk the one before it; vectors that have become parallel are followed once."""
    steps = vectors()[1]
    where = list(range(len(steps)))
    left = len(codes)
    while left and len(set(where)) > 1:
        left -= 1
        step = {v: steps[v][codes[left]] for v in set(where)}
        where = [step[v] for v in where]
    return where if left == 0 else [behind(codes[:left], where[0])[0]] * len(where)


def behind(codes: bytes, end: int) -> list[int]:
    """Cost vector before each row of a chunk, and after its last."""
    steps = vectors()[1]
    out = [end]
    for code in reversed(codes):
        out.append(steps[out[-1]][code])
    return out[::-1]


@lru_cache(maxsize=None)
def choice(state: int, after: int, code: int) -> tuple[str, int, int]:
    """Least edits (in ASCII order) among the cheapest up to and with a row: (initials, state, cost)."""
    costs = vectors()[0][after]
    extra = TRUNCATED if code % 2 and code != GONE else 0
    edits, total, best = "", 0, _row_costs(costs, code)
    while True:
        left = best[state]
        kept = None if code == GONE else _KEPT.get((state, _INITIALS[code // 2]))
        if DELETE + costs[state] == left:
            return edits + "D", state, total + DELETE
        if INSERT + best[_NEXT[state]] == left:
            edits, total, state = edits + "I", total + INSERT, _NEXT[state]
        elif kept is not None and KEEP + extra + costs[kept] == left:
            return edits + "K", kept, total + KEEP + extra
        else:
            return edits + "R", _NEXT[state], total + REROLE + extra


def pass_through(codes: bytes, end: int, state: int) -> int:
    """State after a chunk."""
    for code, after in zip(codes, behind(codes, end)[1:]):
        state = choice(state, after, code)[1]
    return state


def trace(codes: bytes, gone: Sequence[int], roles: Sequence[str], texts: Sequence[str], end: int, state: int, last: bool):
    """Edits, cost and repaired turns of a chunk; ``gone`` counts the rows to delete before each row and at the end."""
    edits, cost, turns = [], 0, []
    for code, after, before, role, text in zip(codes, behind(codes, end)[1:], gone, roles, texts):
        edits.append("D" * before)
        cost += DELETE * before
        made, then, paid = choice(state, after, code)
        for edit in made:
            if edit == "I":
                state = _NEXT[state]
                turns.append((_NAMES[state], ""))
            elif edit != "D":
                turns.append((role if edit == "K" else _NAMES[then], text))
        edits.append(made)
        cost, state = cost + paid, then
    edits.append("D" * gone[-1])
    cost += DELETE * gone[-1]
    while last and state in (SYSTEM, USER):
        state = _NEXT[state]
        turns.append((_NAMES[state], ""))
        edits.append("I")
        cost += INSERT
    return "".join(edits), cost, turns


# --- chunks -----------------------------------------------------------------------------------


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _chunk_schema(conv: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())]
        + [T.StructField("codes", T.BinaryType()), T.StructField("gone", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")]
        + [T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_turns", "turn_first", "turn_last")]
        + [T.StructField(c, T.StringType()) for c in ("first", "last")]
    )


class _Chunk:
    def __init__(self):
        self.codes, self.gone, self.roles, self.texts, self.chars = bytearray(), [0], [], [], 0
        self.counts = dict.fromkeys((*_COUNTS, "n_turns"), 0)
        self.turn_first = self.turn_last = self.first = self.last = None

    def add(self, turn, role: str, n: int, blank: bool, truncated: bool, text: str | None) -> None:
        """``n`` equal rows; the first of them may stay when its text is given."""
        initial = role[:1]
        self.counts["illegal"] += (n - 1) * (initial * 2 not in LEGAL)
        if self.first is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.turn_last:
            self.counts["n_turns"] += 1
            self.turn_last = turn
            self.turn_first = turn if self.turn_first is None else self.turn_first
        if text is not None:
            kind = _INITIALS.find(initial) if initial else 3
            self.codes.append(2 * (kind if kind >= 0 else 3) + truncated)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
            self.counts["truncated"] += truncated
            self.gone.append(0)
            n -= 1
        self.counts["blank" if blank else "duplicate"] += n
        self.gone[-1] += n

    def row(self, conv, part: int, seq: int) -> tuple:
        rows = (bytes(self.codes), self.gone, self.roles, self.texts)
        return (conv, part, seq, *rows, *self.counts.values(), self.turn_first, self.turn_last, self.first, self.last)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _chunker(schema: T.StructType, chunk_rows: int):
    """Chunks of a sorted partition; a conversation's chunks are numbered inside it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        chunk, key, seq, fresh = None, None, 0, None
        for batch in batches:
            for conv, turn, role, digest, text, n, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None:
                    fresh = (conv, turn, role, digest, text)
                    continue
                mine = fresh[4] if fresh is not None and fresh[:4] == (conv, turn, role, digest) else None
                if chunk is not None and (conv != key or len(chunk.codes) >= chunk_rows or chunk.chars >= CHUNK_CHARS):
                    yield batch_of([chunk.row(key, part, seq)], arrow)
                    chunk, seq = None, seq + 1 if conv == key else 0
                if chunk is None:
                    chunk, key = _Chunk(), conv
                chunk.add(turn, role, n, blank, truncated, mine)
        if chunk is not None:
            yield batch_of([chunk.row(key, part, seq)], arrow)

    return cut


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Conversations as chunks of rows in order, with the faults counted."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    base = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"))
    blank = ~F.col("text").rlike(WORD)
    first = (
        base.filter(~blank)
        .groupBy("conv_id", "role", "text")
        .agg(F.min("turn").alias("turn"), F.count_if(F.col("turn").isNull()).alias("_nulls"))
        .withColumn("turn", F.when(F.col("_nulls") == 0, F.col("turn")))
    )
    digest = F.md5(F.col("text").cast("binary"))
    ends = ~blank & ~F.col("text").rlike(ENDS_SENTENCE)
    light = base.select("conv_id", "turn", "role", digest.alias("digest"), blank.alias("blank"), ends.alias("truncated"))
    light = light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None)
    every = light.select("conv_id", "turn", "role", "digest", nothing.cast("string").alias("text"), "n", "blank", "truncated")
    marked = first.select(
        "conv_id", "turn", "role", digest.alias("digest"), "text", F.lit(0).cast("long").alias("n"), F.lit(False), F.lit(False)
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    lined = every.union(marked).repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").desc_nulls_last())
    schema = _chunk_schema(rows.schema["conv_id"].dataType)
    return lined.mapInArrow(_chunker(schema, chunk_rows), schema)


# --- stitching of chunks ------------------------------------------------------------------------


def entering(maps: DataFrame, first: int) -> DataFrame:
    """Value entering each link of the chains ``(conv_id, at, m)``: ``m`` of the links before it applied to ``first`` in turn.

    Fix-up passes: a link that still depends on what enters it takes over the map of the link as far before it
    as it already covers.  Maps that have become constant are done.
    """
    now, reach = cut_lineage(maps.select("conv_id", "at", "m")), 1
    open_ = (F.col("at") >= reach) & (F.size(F.array_distinct("m")) > 1)
    while not now.filter(open_).isEmpty():
        before = now.select("conv_id", (F.col("at") + reach).alias("at"), F.col("m").alias("_b"))
        taken = F.transform("_b", lambda x: F.element_at("m", x + 1))
        both = null_safe_join(now, before, ["conv_id", "at"], "left")
        now = cut_lineage(both.select("conv_id", "at", F.when(open_ & F.col("_b").isNotNull(), taken).otherwise(F.col("m")).alias("m")))
        reach *= 2
        open_ = (F.col("at") >= reach) & (F.size(F.array_distinct("m")) > 1)
    out = now.select("conv_id", (F.col("at") + 1).alias("at"), F.element_at("m", first + 1).alias("value"))
    start = now.filter("at = 0").select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(first).alias("value"))
    return out.unionByName(start)


def _maps(fields: Sequence[T.StructField], work):
    """Task that replaces the columns after the keys by the map that ``work`` makes of them."""
    schema = T.StructType([*fields, T.StructField("m", T.ArrayType(T.IntegerType()))])
    keys = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if rows:
                yield batch_of([(*r[:keys], work(*r[keys:])) for r in rows], arrow)

    return run, schema


def _all_states(codes: bytes, end: int) -> list[int]:
    return [pass_through(codes, end, state) for state in range(4)]


def _long(cut: DataFrame) -> DataFrame:
    """Places ``no`` (from the left) and ``back`` (from the right) of the chunks of conversations of several chunks."""
    runs = cut.groupBy("conv_id", "part").agg((F.max("seq") + 1).alias("_k"))
    whole = Window.partitionBy("conv_id")
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_from", F.sum("_k").over(upto) - F.col("_k")).withColumn("_all", F.sum("_k").over(whole))
    runs = runs.filter(F.col("_all") > 1).drop("_k")
    found = null_safe_join(cut.select("conv_id", "part", "seq", "codes"), runs, ["conv_id", "part"], "inner")
    no = F.col("_from") + F.col("seq")
    return found.select("conv_id", "part", "seq", "codes", no.alias("no"), (F.col("_all") - 1 - no).alias("back"))


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of repaired conversations: ``(conv_id, part, seq, single, audit, cost, turns, counts ...)``.

    ``turns`` are the repaired (role, text) in order; chunks of a conversation follow each other by (part, seq).
    """
    cut = cut_lineage(chunks(rows, chunk_rows))
    conv = cut.schema["conv_id"]
    keys = [T.StructField(c, cut.schema[c].dataType) for c in ("conv_id", "part", "seq")]
    place = [*keys, T.StructField("no", T.LongType()), T.StructField("back", T.LongType())]
    several = cut_lineage(_long(cut))
    if several.isEmpty():
        known = cut.withColumns({"end": F.lit(0), "state": F.lit(START), "single": F.lit(True), "closing": F.lit(True)})
    else:
        run, schema = _maps([conv, T.StructField("at", T.LongType())], speculate)
        right = several.select("conv_id", F.col("back").alias("at"), "codes").mapInArrow(run, schema)
        ends = entering(right, 0).withColumnsRenamed({"at": "back", "value": "end"})
        several = cut_lineage(null_safe_join(several, ends, ["conv_id", "back"], "inner"))
        run, schema = _maps([conv, T.StructField("at", T.LongType())], _all_states)
        left = several.select("conv_id", F.col("no").alias("at"), "codes", "end").mapInArrow(run, schema)
        states = entering(left, START).withColumnsRenamed({"at": "no", "value": "state"})
        several = null_safe_join(several, states, ["conv_id", "no"], "inner")
        several = several.select(*[f.name for f in place], "end", "state")
        known = null_safe_join(cut, several, ["conv_id", "part", "seq"], "left").withColumns(
            {
                "single": F.col("no").isNull(),
                "closing": F.coalesce(F.col("back") == 0, F.lit(True)),
                "end": F.coalesce("end", F.lit(0)),
                "state": F.coalesce("state", F.lit(START)),
            }
        )
    kept = [*_COUNTS, "n_turns", "turn_first", "turn_last", "first", "last"]
    given = ["conv_id", "part", "seq", "single", *kept, "codes", "gone", "roles", "texts", "end", "state", "closing"]
    known = known.select(*given)
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType(
        [f for f in known.schema if f.name in given[: 4 + len(kept)]]
        + [T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("turns", T.ArrayType(turn))]
    )
    n_kept = 4 + len(kept)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                audit, cost, turns = trace(*row[n_kept:])
                out.append((*row[:n_kept], audit, cost, [{"role": r, "text": t} for r, t in turns]))
            if out:
                yield batch_of(out, arrow)

    return known.mapInArrow(write, schema)
