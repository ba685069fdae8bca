"""Product codes of vectors, trained exactly on Hilbert-sorted flat blocks.

A vector is eight parts, each coded by the nearest of up to sixteen entries of its part's codebook.  For training the
parts alone are laid out once: sorted along a Hilbert curve per part position and cut into flat blocks that keep their
points, the box around them and their sums.  In each round the least and greatest distances of a box to the
entries leave a short list of entries that may be nearest to some point of the block.  A block with one entry on its list
adds its stored sums; the others are evaluated point by point against their list in integers.  Sums are exact,
so neither the layout nor the number of tasks changes a result.

The last assignment reads the vectors where they lie, in flat blocks with boxes too, so codes need no join back to ids.

Rows and results.  Components are ``floor(4096 * x)``.  A row is dropped when its vector is null or holds a null, a
non-finite component or one beyond 64 bits, or when its length differs from that of the first kept row by
``vec_id``; a length that is no multiple of eight is an error.  Rows of one ``vec_id`` are ordered by their vectors.
Fewer than sixteen kept rows give as many entries.  Columns other than ``vec_id``, ``embedding`` and ``label``
are not read.  Empty tables give no rows.  An error beyond 64 bits is the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.joins import attach
from caseloom.session import cut_lineage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Points of a flat block; large enough to make boxes pay, small enough to keep them tight.
BLOCK_POINTS = 128
#: Vectors turned into rows at once.
BATCH_VECTORS = 4096
LONGEST = (1 << 63) - 1
_CURVE_BITS = 62


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, label)`` of the kept rows, components as longs."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < 2.0**62))
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(F.coalesce(fits, F.lit(False)))
    rows = rows.select("vec_id", whole.cast("array<long>").alias("v"), "label")
    first = rows.orderBy(F.col("vec_id").asc_nulls_first(), "v").select(F.size("v")).first()
    return rows if first is None else rows.filter(F.size("v") == first[0])


# --- exact kernels on one block --------------------------------------------------------------


def safe(points: np.ndarray, book: np.ndarray) -> bool:
    """Whether all squared distances fit 64 bits."""
    if points.size == 0 or book.size == 0:
        return True
    reach = max(abs(int(points.min())), abs(int(points.max())), abs(int(book.min())), abs(int(book.max())))
    return 4 * reach * reach * points.shape[1] <= LONGEST


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box the entries that may be nearest to a point inside it; an entry leaves only when another is surely nearer."""
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    apart = np.maximum(np.maximum(below, above), 0)
    across = np.maximum(np.abs(below), np.abs(above))
    across = np.maximum(across, np.maximum(high[:, None, :] - book[None], book[None] - low[:, None, :]))
    return (apart * apart).sum(2) <= (across * across).sum(2).min(1)[:, None]


def nearest(points: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point, among the listed entries; ties go to the lower entry."""
    best = np.full(len(points), among[0])
    least = _squares(points - book[among[0]])
    for e in among[1:]:
        d = _squares(points - book[e])
        closer = d < least
        best[closer], least[closer] = e, d[closer]
    return best, least


def _squares(diff: np.ndarray) -> np.ndarray:
    return (diff * diff).sum(1)


def assign(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of points in their order, through flat blocks and their short lists."""
    if not safe(points, book):
        points, book = points.astype(object), book.astype(object)
    at = np.arange(0, len(points), BLOCK_POINTS)
    lists = shortlists(np.minimum.reduceat(points, at, axis=0), np.maximum.reduceat(points, at, axis=0), book)
    done = [nearest(points[a : a + BLOCK_POINTS], book, np.flatnonzero(m)) for a, m in zip(at, lists)]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


# --- layout ------------------------------------------------------------------------------------


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of each point on a Hilbert curve through the box from ``low`` to ``high``.

    Works on all points at once, from the highest bit down: each step undoes the reflection and exchange that the
    curve makes in the cell above, then the bits are read in Gray code.
    """
    dims = min(points.shape[1], _CURVE_BITS)
    bits = min(16, _CURVE_BITS // dims)
    span = np.maximum(high[:dims].astype(float) - low[:dims], 1.0)
    cells = ((points[:, :dims].astype(float) - low[:dims]) / span * ((1 << bits) - 1)).astype(np.int64)
    x = np.ascontiguousarray(np.clip(cells, 0, (1 << bits) - 1).T)
    for b in range(bits - 1, 0, -1):
        bit, rest = 1 << b, (1 << b) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & rest)
            x[0] ^= np.where(on, rest, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(len(points), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(len(points), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pack(points: np.ndarray) -> np.ndarray:
    """Points in the narrowest integers that hold them all."""
    for kind in (np.int16, np.int32):
        if points.size == 0 or (points.min() >= np.iinfo(kind).min and points.max() <= np.iinfo(kind).max):
            return points.astype(kind)
    return points


def _unpack(raw: bytes, width: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[width]
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)


def _layout(low: np.ndarray, high: np.ndarray):
    """Task that turns vectors into (part, place on the curve, salt, width, packed part) rows."""
    dims = len(low) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_VECTORS):
                some = batch.slice(at, BATCH_VECTORS)
                v, salt = matrix(some.column(0)), some.column(1)
                for p in range(PARTS):
                    cut = slice(p * dims, (p + 1) * dims)
                    packed = np.ascontiguousarray(_pack(v[:, cut]))
                    width = packed.itemsize
                    offsets = np.arange(len(v) + 1, dtype=np.int32) * (width * dims)
                    raw = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
                    cols = [pa.array(np.full(len(v), p, np.int32)), pa.array(hilbert_keys(v[:, cut], low[cut], high[cut])), salt]
                    cols += [pa.array(np.full(len(v), width, np.int32)), raw]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "key", "salt", "width", "raw"])

    return run


_BLOCKS = "part int, n long, width int, raw binary, low array<long>, high array<long>, sums array<decimal(38,0)>"


def _block_row(part: int, points: np.ndarray) -> tuple:
    packed = _pack(points)
    sums = points.sum(0) if safe(points, points) else points.astype(object).sum(0)
    return (part, len(points), packed.itemsize, packed.tobytes(), points.min(0).tolist(), points.max(0).tolist(), [int(s) for s in sums])


def _blocks(dims: int):
    """Task that cuts sorted parts into flat blocks."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.decimal128(38, 0))]
    names = ["part", "n", "width", "raw", "low", "high", "sums"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*r[:-1], [Decimal(s) for s in r[-1]]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def close() -> list[tuple]:
            points = np.concatenate(held)
            return [_block_row(part, points[a : a + BLOCK_POINTS]) for a in range(0, len(points), BLOCK_POINTS)]

        for batch in batches:
            out = []
            parts = batch.column(0).to_numpy()
            widths = batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(widths) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(parts)]):
                if a == b:
                    continue
                if held and parts[a] != part:
                    out += close()
                    held, size = [], 0
                part = int(parts[a])
                raw = b"".join(batch.column(2).slice(a, b - a).to_pylist())
                held.append(_unpack(raw, int(widths[a]), dims))
                size += b - a
                if size >= BLOCK_POINTS:
                    points = np.concatenate(held)
                    full = len(points) - len(points) % BLOCK_POINTS
                    held, rest = [points[:full]], points[full:]
                    out += close()
                    held, size = ([rest], len(rest)) if len(rest) else ([], 0)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(close())

    return run


def flat_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """The parts of all vectors in Hilbert order as flat blocks.  Equal parts are dealt by a hash, so no key is hot."""
    each = [f(F.col("v")[i]) for f in (F.min, F.max) for i in range(PARTS * dims)]
    low, high = np.array(rows.agg(*[c.alias(str(k)) for k, c in enumerate(each)]).first(), dtype=np.int64).reshape(2, -1)
    salted = rows.select("v", F.xxhash64("vec_id", "v").alias("salt"))
    lined = salted.mapInArrow(_layout(low, high), "part int, key long, salt long, width int, raw binary")
    lined = lined.repartitionByRange("part", "key", "salt").sortWithinPartitions("part", "key", "salt")
    return lined.select("part", "width", "raw").mapInArrow(_blocks(dims), _BLOCKS)


# --- rounds --------------------------------------------------------------------------------------


def _round(books: list[np.ndarray], dims: int):
    """Task that adds up the points of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}

        def add(part: int, entry: int, n: int, sums) -> None:
            have = totals.setdefault((part, entry), [0, [0] * dims])
            have[0] += n
            have[1] = [a + int(b) for a, b in zip(have[1], sums)]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts, counts, widths = (batch.column(i).to_numpy() for i in range(3))
            low, high = matrix(batch.column(4)), matrix(batch.column(5))
            for part in np.unique(parts):
                at, book = np.flatnonzero(parts == part), books[part]
                box = np.concatenate([low[at], high[at]])
                wide = not safe(box, book)
                a, b, c = (x.astype(object) if wide else x for x in (low[at], high[at], book))
                for i, listed in zip(at.tolist(), shortlists(a, b, c)):
                    among = np.flatnonzero(listed)
                    if len(among) == 1:
                        add(int(part), int(among[0]), int(counts[i]), batch.column(6)[i].as_py())
                        continue
                    points = _unpack(batch.column(3)[i].as_py(), int(widths[i]), dims)
                    points = points.astype(object) if wide else points
                    entry, _ = nearest(points, c, among)
                    for e in among[np.isin(among, entry)]:
                        mine = points[entry == e]
                        add(int(part), int(e), len(mine), mine.sum(0))
        if totals:
            cols = [[k[0] for k in totals], [k[1] for k in totals], [t[0] for t in totals.values()]]
            sums = [[Decimal(s) for s in t[1]] for t in totals.values()]
            kinds = [pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(sums, pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    return run


def train(rows: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebook of each part position after ``rounds`` rounds; no books for an empty table."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_first(), "v").select("v").limit(ENTRIES).collect()
    if not first:
        return []
    start = np.array([r[0] for r in first], dtype=np.int64)
    if start.shape[1] == 0 or start.shape[1] % PARTS:
        raise ValueError(f"vectors of {start.shape[1]} components cannot be cut into {PARTS} equal parts")
    dims = start.shape[1] // PARTS
    books = [start[:, p * dims : (p + 1) * dims].copy() for p in range(PARTS)]
    blocks = cut_lineage(flat_blocks(rows, dims))
    for _ in range(rounds):
        found = blocks.mapInArrow(_round(books, dims), "part int, entry int, n long, sums array<decimal(38,0)>")
        each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
        for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # at most PARTS * ENTRIES rows
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, code, error, label)``: two hex digits a part, and the summed squared distances."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = matrix(batch.column(1))
            dims = v.shape[1] // PARTS
            entries, errors = zip(*(assign(v[:, p * dims : (p + 1) * dims], book) for p, book in enumerate(books)))
            codes = [bytes(c).hex() for c in np.stack(entries, 1).astype(np.uint8)]
            error = [min(LONGEST, sum(map(int, e))) for e in zip(*errors)]
            arrays = [batch.column(0), pa.array(codes), pa.array(error, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "code", "error", "label"])

    return rows.select("vec_id", "v", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, code string, error long, label {kinds['label']}")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()


def product_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every kept vector."""
    rows = usable(vectors)
    books = train(rows, rounds)
    coded = cut_lineage(encode(rows, books))
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    per_label = per_label.select("label", F.least("_sum", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = attach(coded, per_label, ["label"], "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
