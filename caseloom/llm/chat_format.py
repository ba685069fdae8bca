"""Chat formatting: conversations as budgeted windows of whole turns with a mask of what is to be learnt.

Turns are written as ``<|role|>``, a line end, the text, ``<|end|>`` and a line end.  Texts and roles are escaped so that no mark of
this or of bracket templates can occur in them: a backslash is doubled, and ``<`` and ``[`` are followed by one.
A conversation is dealt into stretches of ``STRETCH`` turns by rank, so a long one is shared by many tasks; inside a
stretch prefix sums of turn tokens choose the longest spans of whole turns that fit the budget.  A window repeats the
system turn that opens the conversation and the last turns before it that fit ``history``, those of the stretch
before too: each stretch is handed as many of them as could fit.  A window ends with its stretch.  Only the
assistant texts of a window's own turns are under the mask, so each is learnt once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caseloom.llm import token_counts
from caseloom.session import ship_package

BUDGET, HISTORY, STRETCH = 512, 128, 256
#: Tokens that the marks of a turn take.
MARKS = 4

WINDOW_SCHEMA = (
    "stretch long, window int, n_turns int, n_repeated int, n_tokens long, formatted string,"
    " loss array<struct<first:int,last:int>>"
)
_TURN = re.compile(r"<\|((?:[^<\[\\]|[<\[]\\|\\\\)*?)\|>\n((?:[^<\[\\]|[<\[]\\|\\\\)*)<\|end\|>\n")
_ESCAPED = re.compile(r"([<\[])\\|\\\\")


def escape(text: str) -> str:
    return re.sub(r"[<\[]", r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1) or "\\", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A written turn and where its text lies in it."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first and last place of the written text) of each turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2)), m.start(2), m.end(2)))
        at = m.end()
    return out


def spans(tokens: np.ndarray, room: int, history: int, start: int = 0) -> list[tuple[int, int, int]]:
    """(first repeated, first own, end) turn of each window from ``start`` on; a turn over the budget stands alone."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    out = []
    while start < len(tokens):
        back = int(np.searchsorted(sums, sums[start] - history, "left"))
        end = int(np.searchsorted(sums, sums[back] + room, "right")) - 1
        if end <= start:  # the history gives way to the next turn
            back = min(start, int(np.searchsorted(sums, sums[start + 1] - room, "left")))
            end = start + 1
        out.append((back, start, end))
        start = end
    return out


def _windows(
    rows: list[tuple], before: int, system: str | None, system_tokens: int, opening: bool, budget: int, history: int
) -> Iterator[tuple]:
    """Windows of the turns (role, text, tokens) of a stretch, the first ``before`` of them being those of the stretch
    before; the opening one holds the system turn for the first time."""
    tokens = np.array([r[2] for r in rows], dtype=np.int64)
    room = max(1, budget - system_tokens)
    cuts = spans(tokens, room, min(history, room // 2), before) or ([(0, 0, 0)] if opening else [])
    for number, (back, start, end) in enumerate(cuts):
        text, loss, at, repeated = [], [], 0, start - back
        if system is not None:
            text.append(render("system", system)[0])
            at += len(text[0])
            repeated += 0 if opening and number == 0 else 1
        for k in range(back, end):
            piece, first, last = render(rows[k][0], rows[k][1])
            if k >= start and rows[k][0] == "assistant":
                loss.append({"first": at + first, "last": at + last})
            text.append(piece)
            at += len(piece)
        total = int(tokens[back:end].sum()) + system_tokens
        yield number, len(text), repeated, total, "".join(text), loss


def format_chats(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH, tokenizer: str | None = None
) -> DataFrame:
    """Windows of all conversations: ``conv_id, stretch, window, n_turns, n_repeated, n_tokens, formatted, loss``.

    Tokens of a text are those of the vocabulary file ``tokenizer`` (as ``token_counts``), without one its words.
    ``loss`` are spans of ``formatted`` in code points.  The first ``n_repeated`` turns of a window stand in an
    earlier one too.  Rows of equal turn numbers are ordered by role, then text; repeated rows are turns of their
    own.  Null roles and texts are empty, a null turn number is -1, a null conversation is one conversation.  An
    empty table gives none; other columns are left behind.
    """
    ship_package(turns.sparkSession)
    if tokenizer is not None:
        turns.sparkSession.sparkContext.addFile(tokenizer)
        tokenizer = tokenizer.rsplit("/", 1)[-1]
    most = history // MARKS  # turns that can fit the history
    stretch = max(stretch, most + 1)
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("group", F.expr(f"floor(turn / {stretch})"))
    # Rank of a turn: turns of the groups of turn numbers before its own, and its place in its group.
    said = F.when(F.col("role") == "system", F.col("text")).alias("text")
    groups = rows.groupBy("conv", "none", "group").agg(F.count("*").alias("n"), F.min(F.struct("turn", "role", said)).alias("h"))
    by_group = Window.partitionBy("conv", "none").orderBy("group")
    groups = groups.select(
        "conv", "none", "group",
        F.coalesce(F.sum("n").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.first("h.text").over(by_group).alias("system"),
    )
    groups = groups.filter("base > 0 OR system IS NOT NULL")
    order = Window.partitionBy("conv", "none", "group").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order) - 1).join(groups, ["conv", "none", "group"], "left")
    rows = rows.select("conv_id", (F.coalesce("base", F.lit(0)) + F.col("place")).alias("rank"), "role", "text", "system")
    # The last turns of a stretch go to the next one too.
    own = F.expr(f"rank div {stretch}")
    dealt = F.when(F.col("rank") % stretch >= stretch - most, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("conv_id", F.explode(dealt).alias("stretch"), "rank", "role", "text", "system")
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "rank")
    schema = f"conv_id {kind}, {WINDOW_SCHEMA}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counts.counter(tokenizer).count if tokenizer is not None else lambda t: ([len(x.split()) for x in t], [])
        key, held, before, head = None, [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) == before and not head[2]:
                return  # nothing but turns of the stretch before
            made = [(*key, *w) for w in _windows(held, before, *head, budget, history)]
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, m)) for m in made], schema=arrow)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            tokens = count(columns[4])[0]
            for conv, number, rank, role, text, system, size in zip(*columns, tokens):
                if key != (conv, number):
                    if key is not None:
                        yield from close()
                    opening = system is not None and rank == 0
                    own = 0 if system is None else size if opening else count([system])[0][0]
                    key, held, before, head = (conv, number), [], 0, (system, own + MARKS if system is not None else 0, opening)
                    if opening:
                        continue
                held.append((role, text, size + MARKS))
                before += rank < number * stretch
        if key is not None:
            yield from close()

    return dealt.mapInArrow(run, schema)
