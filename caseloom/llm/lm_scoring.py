"""Interpolated modified Kneser-Ney model: n-grams counted in Spark, stored as sorted hash arrays, mapped by workers.

Every level (n-grams of 1 to ``order`` words) is cut into shards by the top bits of a 64-bit hash.  A shard is two
files in the shared folder, the sorted hashes and their counts; tasks write them under a temporary name and
rename them, so a retried task replaces equal files.  Scoring tasks map the files and search them for
the sorted hashes of a run of documents; nothing of the model passes the driver but shard names and, per level,
four counts of counts.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shared
from caseloom.session import cut_lineage, ship_package, use_checkpoint_dir

END = np.uint64(0xE0D5E0D5E0D5E0D5)
BEGIN = np.uint64(0xB0E6B0E6B0E6B0E6)
#: Tokens a task gathers before it merges equal n-grams and sends them on.
GATHERED = 2_500_000
#: Tokens per shard, from which the number of shards follows.
SHARD_TOKENS = 1_000_000

BLOB = "kind string, shard int, data binary"


def held_out_expr(doc_id: Column) -> Column:
    """True for ids whose crc32 as text is a multiple of ten; null ids are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def padded(w: shared.Words, docs: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token sequence with ``order - 1`` begins and one end per text, the text of each token, places of real tokens."""
    counts = w.per_doc(docs)
    width = counts + order
    base = np.cumsum(width) - width
    seq = np.full(int(width.sum()), BEGIN, dtype=np.uint64)
    doc = np.repeat(np.arange(docs), width)
    first = np.cumsum(counts) - counts
    seq[base[w.doc] + order - 1 + np.arange(len(w.hash)) - first[w.doc]] = w.hash
    seq[base + width - 1] = END
    real = np.arange(len(seq)) - base[doc] >= order - 1
    return seq, doc, np.flatnonzero(real)


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal key rows once, their values summed; sorted by the first key first."""
    if len(keys[0]) == 0:
        return keys, values
    by = np.lexsort(keys[::-1])
    keys = [k[by] for k in keys]
    new = np.zeros(len(by), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[by], at) for v in values]


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def pack(keys: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.save(out, np.array([len(keys), len(values)]))
    for k in keys:
        np.save(out, k)
    for v in values:
        np.save(out, narrow(v))
    return out.getvalue()


def unpack(blobs) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys, values = [], []
    for b in blobs:
        got = io.BytesIO(b)
        n_keys, n_values = np.load(got)
        keys.append([np.load(got) for _ in range(n_keys)])
        values.append([np.load(got).astype(np.int64) for _ in range(n_values)])
    return [np.concatenate(k) for k in zip(*keys)], [np.concatenate(v) for v in zip(*values)]


def by_shard(kind: str, shards: int, route: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    """One row per shard with its part of the arrays."""
    shard = (route >> np.uint64(32)).astype(np.int64) * shards >> 32
    by = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[by], np.arange(shards + 1))
    rows = [(s, by[a:b]) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(rows), pa.string()),
            pa.array([s for s, _ in rows], pa.int32()),
            pa.array([pack([k[i] for k in keys], [v[i] for v in values]) for _, i in rows], pa.binary()),
        ],
        names=["kind", "shard", "data"],
    )


class Folder:
    """Numpy files in the shared folder; mapped where they lie if it is mounted, else from a copy by the worker."""

    def __init__(self, uri: str):
        self.uri = uri
        got = urlparse(uri)
        self.local = got.path if got.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def save(self, name: str, array: np.ndarray) -> None:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, array)
            os.replace(part, f"{self.local}/{name}.npy")
            return
        store, top = self._remote()
        store.create_dir(top)
        part = f"{top}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            np.save(f, array)
        store.move(part, f"{top}/{name}.npy")

    def map(self, name: str) -> np.ndarray:
        if self.local is not None:
            return np.load(f"{self.local}/{name}.npy", mmap_mode="r")
        store, top = self._remote()
        with tempfile.NamedTemporaryFile(suffix=".npy") as copy, store.open_input_stream(f"{top}/{name}.npy") as f:
            while block := f.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.load(copy.name, mmap_mode="r")  # the map outlives the name


def _count_top(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*gathered)]
            keys, (n,) = merged(cols, [np.ones(len(cols[0]), dtype=np.int64)])
            # Values: count at this level, and raw count of the last word.
            return by_shard("level", shards, shared.combine(keys), keys, [n, n])

        for batch in batches:
            for lo, hi, data, offsets in shared.pieces(batch.column(0)):
                seq, _, at = padded(shared.split_words(data, offsets, shared.SPACE_WORDS), hi - lo, order)
                gathered.append([seq[at - order + 1 + j] for j in range(order)])
                size += len(at)
                if size >= GATHERED:
                    yield flush()
                    gathered, size = [], 0
        if size:
            yield flush()

    return run


def _build(level: int, shards: int, folder: Folder):
    """Store one shard of a level; send its context statistics and the next lower level on."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, (count, raw) = merged(*unpack(b.as_py() for b in table.column("data")))
        h = shared.combine(keys)
        by = np.argsort(h)
        name = f"level{level}-{shard}"
        folder.save(f"{name}-keys", h[by])
        folder.save(f"{name}-counts", narrow(np.stack([count[by], raw[by]]) if level == 1 else count[by]))
        tops = np.array([len(h), count.sum(), *((count == k).sum() for k in (1, 2, 3, 4)), raw.sum()])
        out = [
            pa.RecordBatch.from_arrays(
                [pa.array(["stats"]), pa.array([shard], pa.int32()), pa.array([tops.astype(np.int64).tobytes()], pa.binary())],
                names=["kind", "shard", "data"],
            )
        ]
        if level > 1:
            context = shared.combine(keys[:-1])
            parts = [count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64)]
            own, sums = merged([context], parts)
            out.append(by_shard("context", shards, own[0], own, sums))
            lower, (n, raw) = merged(keys[1:], [np.ones(len(h), dtype=np.int64), raw])
            out.append(by_shard("level", shards, shared.combine(lower), lower, [n, raw]))
        return pa.Table.from_batches(out)

    return run


def _build_contexts(level: int, folder: Folder):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        (key,), sums = merged(*unpack(b.as_py() for b in table.column("data")))
        folder.save(f"context{level}-{shard}-keys", key)
        folder.save(f"context{level}-{shard}-counts", narrow(np.stack(sums)))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts; plain ones where those are too few."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0, [0, 1, 2, 3])


class Model:
    """Where the arrays lie and the few numbers that belong to whole levels; small, sent with tasks."""

    def __init__(self, folder: Folder, order: int, shards: int, stats: dict[int, np.ndarray], present: dict[str, list[int]]):
        self.folder, self.order, self.shards, self.stats, self.present = folder, order, shards, stats, present
        self.discount = {k: discounts(s[2:6]) for k, s in stats.items()}
        self.train_tokens = int(stats[1][6])
        self.vocabulary = int(stats[1][0])

    def open(self) -> None:
        self.maps = {
            (kind, s): (self.folder.map(f"{kind}-{s}-keys"), self.folder.map(f"{kind}-{s}-counts"))
            for kind, all_shards in self.present.items()
            for s in all_shards
        }

    def find(self, kind: str, queries: np.ndarray, rows: int) -> np.ndarray:
        """Stored values of each query hash (``rows`` of them), zero where absent."""
        unique, back = np.unique(queries, return_inverse=True)
        out = np.zeros((rows, len(unique)), dtype=np.int64)
        shard = (unique >> np.uint64(32)).astype(np.int64) * self.shards >> 32
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in self.present.get(kind, []):
            a, b = edges[s], edges[s + 1]
            if a == b:
                continue
            keys, counts = self.maps[kind, s]
            at = np.minimum(np.searchsorted(keys, unique[a:b]), len(keys) - 1)
            hit = keys[at] == unique[a:b]
            out[:, a:b][:, hit] = counts[..., at[hit]]
        return out[:, back]

    def log_probabilities(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the tokens at the given places, and the raw training count of each."""
        p = np.full(len(at), 1.0 / (self.vocabulary + 1))
        raw = np.zeros(len(at), dtype=np.int64)
        for level in range(1, self.order + 1):
            words = [seq[at - level + 1 + j] for j in range(level)]
            found = self.find(f"level{level}", shared.combine(words), 2 if level == 1 else 1)
            count = found[0]
            if level == 1:
                raw = found[1]
                s = self.stats[1]
                total = np.full(len(at), s[1])
                ones, twos, more = (np.full(len(at), x) for x in (s[2], s[3], s[0] - s[2] - s[3]))
            else:
                total, ones, twos, more = self.find(f"context{level}", shared.combine(words[:-1]), 4)
            d = self.discount[level]
            known = total > 0
            safe = np.where(known, total, 1)
            direct = np.maximum(count - d[np.minimum(count, 3)], 0) / safe
            back = (d[1] * ones + d[2] * twos + d[3] * more) / safe
            p = np.where(known, direct + back * p, p)
        return np.log10(p), raw


def fit(texts: DataFrame, order: int = 3, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Model of a text column; its arrays go to a new folder below the shared checkpoint folder."""
    spark = texts.sparkSession
    ship_package(spark)
    folder = Folder(f"{use_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}")
    chars = texts.select(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(chars / 6 / shard_tokens) + 1)
    level = texts.select(F.col("text").cast("string")).mapInArrow(_count_top(order, shards), BLOB)
    stats, present = {}, {}
    for k in range(order, 0, -1):
        built = cut_lineage(level.repartition(max(shards, 2), "shard").groupBy("shard").applyInArrow(_build(k, shards, folder), BLOB))
        rows = built.filter("kind = 'stats'").select("shard", "data").collect()
        stats[k] = sum((np.frombuffer(r["data"], np.int64) for r in rows), np.zeros(7, np.int64))
        present[f"level{k}"] = sorted(r["shard"] for r in rows)
        if k > 1:
            contexts = built.filter("kind = 'context'").repartition(max(shards, 2), "shard").groupBy("shard")
            present[f"context{k}"] = sorted(r[0] for r in contexts.applyInArrow(_build_contexts(k, folder), "shard int").collect())
            level = built.filter("kind = 'level'")
    return Model(folder, order, shards, stats, present)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Every document under the model: ``id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Null and empty texts are one end token.  Rows are independent and may repeat; an empty table gives none;
    other columns are left behind.  A model of no text gives every token probability 1 over one class.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        floor = model.train_tokens + 0.1 * (model.vocabulary + 1)
        for batch in batches:
            for lo, hi, data, offsets in shared.pieces(batch.column(1)):
                n = hi - lo
                seq, doc, at = padded(shared.split_words(data, offsets, shared.SPACE_WORDS), n, model.order)
                logs, raw = model.log_probabilities(seq, at)
                own = doc[at]
                tokens = np.bincount(own, minlength=n)
                total = np.bincount(own, weights=logs, minlength=n)
                base = np.bincount(own, weights=np.log10((raw + 0.1) / floor), minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(tokens, pa.int64()),
                        pa.array(np.bincount(own[raw > 0], minlength=n), pa.int64()),
                        pa.array(np.full(n, model.train_tokens), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(total, pa.float64()),
                        pa.array(10.0 ** (-total / tokens), pa.float64()),
                    ],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
