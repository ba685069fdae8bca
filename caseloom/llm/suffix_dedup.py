"""Suffix-array dedup: removes the bytes of every ``LENGTH``-byte string that also starts earlier in the corpus.

1. Anchors: in each window of 100 bytes the 32-byte run of the smallest hash is marked, so equal 100-byte strings
   mark the same place.  An anchor's context is the bytes of all 100-byte strings that mark it.
2. Anchors are dealt by their hash, after a look for equal contexts in each run of documents.  An occurrence whose whole context stood earlier is removed at once; if a hash
   has several contexts, the first occurrence of each goes on.  Copies and passages shared by many documents are
   one context, however many.
3. These contexts, dealt by anchor hash, are divided into bands of neighbouring strings.  A band that stood earlier is
   removed at once, one whose common bytes stand in no other context of the anchor is left; the first occurrences of
   the others are put together to shards of about two megabytes.  Each shard gets its suffix array by induced sorting
   and its permuted common prefixes; in a run of suffixes with common prefixes of 100 bytes or more all but the
   earliest are removed.
4. An anchor with more contexts than ``HOT_CONTEXTS`` is not put in one shard: its strings are grouped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shared
from caseloom.llm.suffix_arrays import permuted_prefixes, suffix_array
from caseloom.session import cut_lineage, ship_package

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Bytes of contexts in one suffix array, and contexts of one anchor that may share one.
SHARD_BYTES, HOT_CONTEXTS = 2 << 20, 20_000
#: Strings around an anchor that are looked at together before the suffix arrays.
BAND = 12
#: Never part of UTF-8 text: stands between contexts.
BETWEEN = 255


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of ``width`` values, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in the text, anchor hash, context hash, bytes to the left, bytes to the right) of all anchors."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < LENGTH:
        return none
    sums, inverse = shared.rolling(data)
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    h = shared.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1]) | np.uint64(1)
    crossing = text_of[: n - GRAM + 1] != text_of[GRAM - 1 :]
    order = h.copy()
    order[crossing] = np.uint64(2**64 - 1)
    least = _sliding(order, REACH + 1, np.minimum)
    least[text_of[: n - LENGTH + 1] != text_of[LENGTH - 1 :]] = 0
    pad = np.zeros(REACH, dtype=np.uint64)
    reach = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero((reach == h) & ~crossing)
    text = text_of[at]
    place = at - offsets[text]
    # Strings that hold a smaller hash are marked there, so a context ends where such a string begins.
    below, above = _smaller(text, at, h[at])
    left = np.minimum(np.minimum(place, REACH), at - below - 1)
    right = np.minimum(np.minimum(offsets[text + 1] - at, LENGTH), above + GRAM - 1 - at)
    lo, hi = at - left, at + right
    context = shared.mix((sums[hi] - sums[lo]) * inverse[lo] + (left * 1000 + right).astype(np.uint64))
    return text, place, h[at], context, left, right


def _smaller(text: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest anchors of a smaller hash before and after each anchor, far away if out of its reach.

    Only neighbours matter: between two anchors of smaller hashes in reach, one of a larger hash would be least nowhere.
    Equal hashes in a row share their neighbours.
    """
    n = len(at)
    far = 4 * LENGTH
    new = np.ones(n, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    run = np.cumsum(new) - 1
    before, after = first[run] - 1, (last + 1)[run]
    known = before >= 0
    known[known] = (text[before[known]] == text[known]) & (h[before[known]] < h[known])
    below = np.where(known, at[before], at - far)
    known = after < n
    known[known] = (text[after[known]] == text[known]) & (h[after[known]] < h[known])
    above = np.where(known, at[np.minimum(after, n - 1)], at + far)
    return below, above


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in shared.pieces(batch.column(1), limit=(1 << 20) - 64):
            text, place, h, c, left, right = anchors(data, offsets)
            doc = np.asarray(batch.column(0).slice(lo, hi - lo))[text]
            # Of equal contexts met together only the earliest needs comparing; the others are spread evenly.
            by = np.lexsort((place, doc, c, h))
            sure = np.zeros(len(by), dtype=bool)
            sure[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (c[by[1:]] == c[by[:-1]])
            h = np.where(sure, shared.mix(doc.astype(np.uint64) * np.uint64(1 << 32) + place.astype(np.uint64)), h.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(c.view(np.int64)),
                    pa.array(doc, pa.int64()),
                    pa.array(place, pa.int32()),
                    pa.array(left, pa.int16()),
                    pa.array(right, pa.int16()),
                    pa.array(sure, pa.bool_()),
                ],
                names=["h", "c", "doc", "at", "l", "r", "sure"],
            )


def runs_of(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (doc, first byte, end) covered by the strings that start at the given places."""
    if not len(doc):
        return doc, start, start
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + LENGTH


def repeated_in(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte runs (doc, first, end) of the strings in some contexts that start earlier in another."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    t = np.frombuffer(bytes([BETWEEN]).join(contexts) + bytes([BETWEEN]), np.uint8)
    base = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    order = suffix_array(t, 256)
    common = permuted_prefixes(t, order, LENGTH)[order]
    rest = (base + sizes)[owner[order]] - order
    whole = rest >= LENGTH
    # Suffixes of one run share their first 100 bytes, so a suffix cut short never stands among them.
    joined = whole.copy()
    joined[1:] &= whole[:-1] & (common[1:] >= LENGTH)
    joined[0] = False
    group = np.cumsum(~joined)[whole]
    order = order[whole]
    own = doc[owner[order]]
    place = start[owner[order]] + order - base[owner[order]]
    by = np.lexsort((place, own, group))
    group, own, place = group[by], own[by], place[by]
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
    later = (own != own[first]) | (place != place[first])
    return runs_of(own[later], place[later])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of true values in each row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def divide(h: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, base: np.ndarray) -> tuple:
    """Bands of contexts seen before, and those that may repeat in part: (row, bytes left of the anchor, bytes right) each.

    A band is the ``BAND`` strings next to each other around an anchor; equal strings stand in the same band of the same
    anchor.  If all bytes of a band stood earlier, it is removed at once.  If some contexts differ in the band but share
    the bytes that all its strings have, their first occurrences go on; the other bands repeat nowhere.
    """
    sums, inverse = shared.rolling(data)
    value = lambda lo, hi: (sums[hi] - sums[lo]) * inverse[lo]
    anchor, key = base + left, h.view(np.uint64)
    starts = np.arange(0, REACH + 1, BAND)
    gone, going = (np.zeros((len(h), len(starts)), dtype=bool) for _ in range(2))
    for j, near in enumerate(starts):
        far = min(near + BAND - 1, REACH)
        least, most = np.maximum(near, LENGTH - right), np.minimum(far, left)
        own = np.flatnonzero(least <= most)
        least, most, place = least[own], most[own], anchor[own]
        whole = shared.mix(value(place - most, place + LENGTH - least) + (least * LENGTH + most).astype(np.uint64)) ^ key[own]
        by = np.lexsort((at[own], doc[own], whole))
        own, whole = own[by], whole[by]
        seen = np.zeros(len(own), dtype=bool)
        seen[1:] = whole[1:] == whole[:-1]
        first = own[np.flatnonzero(~seen)[np.cumsum(~seen) - 1]]
        gone[own, j] = (doc[own] != doc[first]) | (at[own] != at[first])
        own = own[~seen]
        common = shared.mix(value(anchor[own] - near, anchor[own] + LENGTH - far)) ^ key[own]
        by = np.argsort(common)
        own, common = own[by], common[by]
        met = np.zeros(len(own), dtype=bool)
        met[1:] = common[1:] == common[:-1]
        met[:-1] |= met[1:]
        going[own[met], j] = True
    out = []
    for flags in (gone, going):
        row, first, last = _runs(flags)
        least = np.maximum(starts[first], LENGTH - right[row])
        most = np.minimum(np.minimum(starts[last] + BAND - 1, REACH), left[row])
        out.append((row, most, LENGTH - least))
    return tuple(out)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor hash: whole anchors at a time are divided, what may repeat goes to suffix arrays."""
    pieces: list[bytes] = []
    owners: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        return span_batch(*repeated_in(pieces, np.concatenate(owners), np.concatenate(starts)))

    for rows in _whole_anchors(batches):
        h, doc, start, left = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
        context = rows.column(4).cast(pa.large_binary()).chunk(0)
        offsets = np.frombuffer(context.buffers()[1], np.int64)[context.offset : context.offset + len(context) + 1]
        data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        base = offsets[:-1] - offsets[0]
        at = start + left
        gone, going = divide(h, doc, at, left, np.diff(offsets) - left, data, base)
        row, before, behind = gone
        if len(row):
            yield span_batch(doc[row], at[row] - before, at[row] + behind)
        row, before, behind = going
        if len(row):
            place = base[row] + left[row]
            raw = data.tobytes()
            pieces += [raw[a:b] for a, b in zip((place - before).tolist(), (place + behind).tolist())]
            owners.append(doc[row])
            starts.append(at[row] - before)
            size += int((before + behind + 1).sum())
        if size >= SHARD_BYTES:
            yield close()
            pieces, owners, starts, size = [], [], [], 0
    if pieces:
        yield close()


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables of one chunk and about ``SHARD_BYTES`` that never part equal values."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SHARD_BYTES or batch.column(0)[-1] == held[0].column(0)[0]:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        edge = int(np.searchsorted(rows.column(0).to_numpy(), batch.column(0)[-1].as_py()))
        yield rows.slice(0, edge)
        held = rows.slice(edge).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def span_batch(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, lo, hi)], names=["doc", "lo", "hi"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc, lo, hi``: byte ranges to remove; they may overlap."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH))
    marked = texts.mapInArrow(_mark, "h long, c long, doc long, at int, l short, r short, sure boolean")
    spec = "(PARTITION BY h ORDER BY c, doc, at"
    every = f"{spec} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    seen = marked.select(
        "*",
        F.expr(f"NOT sure AND coalesce(lag(c) OVER {spec}) <> c, true)").alias("first"),
        F.expr(f"first_value(c) OVER {every} <> last_value(c) OVER {every}").alias("several"),
    )
    # Copies of a single context need nothing more than their own row; the others are kept with their place.
    seen = seen.filter("several OR NOT first").select(
        "h", "doc", "l", "first", "several", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + F.col("r")).alias("hi")
    )
    seen = cut_lineage(seen)
    whole = seen.filter("NOT first").select("doc", F.col("lo").cast("long"), F.col("hi").cast("long"))

    several = seen.filter("first AND several")
    per_doc = several.groupBy("doc").agg(F.collect_list(F.struct("h", "l", "lo", "hi")).alias("at"))
    bytes_ = texts.join(per_doc, "doc").select(
        "doc", F.explode(F.expr("transform(at, s -> struct(s.h, s.l, s.lo, substring(cast(text AS binary), s.lo + 1, s.hi - s.lo) AS context))")).alias("s")
    )
    contexts = cut_lineage(bytes_.select("s.h", "doc", F.col("s.lo").alias("start"), "s.l", "s.context"))
    hot = contexts.groupBy("h").count().filter(F.col("count") > HOT_CONTEXTS).select("h")
    hot = cut_lineage(hot)
    columns = ["h", "doc", "start", "l", "context"]
    plain = contexts.join(hot, "h", "left_anti").select(*columns)
    spans = plain.repartition("h").sortWithinPartitions("h").mapInArrow(_shards, "doc long, lo long, hi long")
    strings = contexts.join(hot, "h", "left_semi").select(
        "doc", "start", "context", F.explode(F.expr(f"sequence(0, greatest(length(context) - {LENGTH}, 0))")).alias("k")
    )
    strings = strings.select("doc", (F.col("start") + F.col("k")).cast("long").alias("lo"), F.expr(f"md5(substring(context, k + 1, {LENGTH}))").alias("m"))
    earliest = strings.groupBy("m").agg(F.min(F.struct("doc", "lo")).alias("e"))
    late = strings.join(earliest, "m").filter("e.doc <> doc OR e.lo <> lo").select("doc", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return whole.unionByName(spans).unionByName(late)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, cuts in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = (text.as_py() or "").encode()
            own = []
            for c in sorted(cuts or [], key=lambda c: c["lo"]):
                if own and c["lo"] <= own[-1]["last"]:
                    own[-1]["last"] = max(own[-1]["last"], c["hi"])
                else:
                    own.append({"first": c["lo"], "last": c["hi"]})
            at, parts = 0, []
            for s in own:
                parts.append(raw[at : s["first"]])
                at = s["last"]
            parts.append(raw[at:])
            sizes.append(len(raw))
            spans.append(own)
            kept.append(b"".join(parts))
            removed.append(len(raw) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "spans", "kept"],
        )


def dedup_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document ``id_col, n_bytes, n_removed, spans`` (maximal removed byte runs) and ``kept`` (bytes left).

    Matches never cross documents; null texts are empty; documents without an id are not compared.  Ids must be
    integers and name one document each: rows repeated with one id and text are taken for one document and
    all get its cuts.  An empty table gives none; other columns are left behind.
    """
    ship_package(docs.sparkSession)
    spans = repeated_spans(docs, id_col)
    cuts = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(cuts, F.col("id").cast("long") == F.col("doc"), "left").select("id", "text", "cuts")
    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary"
    return rows.mapInArrow(_cut, schema).withColumnRenamed("id", id_col)
