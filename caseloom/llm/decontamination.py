"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

A window is ``window`` consecutive words of an item (a shorter item is one window), its set the word
shingles in it.  Shingles are ordered by how many documents hold them.  Exact containment needs every
shingle of the window, so the necessary prefix is the single rarest one: only its occurrences in documents are
candidates.  The place of the shingle in the window gives the place of the window in the document (positional
bound), which must hold it whole (length bound); then all words are compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shared
from caseloom.session import cut_lineage, ship_package

#: Item words sent to every task at once; a larger benchmark is joined in blocks of items of about this size.
BLOCK_WORDS = 1_000_000


class Windows:
    """Distinct windows of a block of items, with the shingles they hold."""

    def __init__(self, item_ids: list[str], texts: list, window: int, shingle: int):
        self.ids = item_ids
        self.window, self.shingle = window, shingle
        spans, lengths, owners, wide = [], [], [], []
        for lo, hi, data, offsets in shared.pieces(pa.array(texts, pa.string())):
            w = shared.split_words(data, offsets, shared.PLAIN_WORDS)
            counts = w.per_doc(hi - lo)
            ends = np.cumsum(counts)
            for i in np.flatnonzero(counts):
                own = w.hash[ends[i] - counts[i] : ends[i]]
                size = min(window, len(own))
                view = np.lib.stride_tricks.sliding_window_view(own, size)
                padded = np.zeros((len(view), window), dtype=np.uint64)
                padded[:, :size] = view
                wide.append(padded)
                lengths.append(np.full(len(view), size))
                owners.append(np.full(len(view), lo + i))
        self.words = np.concatenate(wide) if wide else np.zeros((0, window), np.uint64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        # (window, offset, shingle); items shorter than a shingle use shingles of their own length.
        self.sizes = sorted({int(min(shingle, n)) for n in np.unique(self.length)})
        rows = []
        for size in self.sizes:
            at = np.flatnonzero(np.minimum(shingle, self.length) == size)
            for off in range(window - size + 1):
                ok = at[self.length[at] >= off + size]
                if len(ok):
                    h = shared.combine([self.words[ok, off + j] for j in range(size)])
                    rows.append((ok, np.full(len(ok), off), h, np.full(len(ok), size)))
        cat = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(4)]
        self.sh_window, self.sh_offset, self.sh_size = cat[0], cat[1], cat[3]
        self.keys, self.sh_key = np.unique(cat[2].astype(np.uint64), return_inverse=True)

    def order(self, document_counts: np.ndarray) -> None:
        """Keep of each window its rarest shingle."""
        by = np.lexsort((self.sh_offset, self.sh_key, document_counts[self.sh_key], self.sh_window))
        first = by[np.unique(self.sh_window[by], return_index=True)[1]] if len(by) else by
        first = first[np.argsort(self.sh_key[first], kind="stable")]
        self.pre_window, self.pre_offset = self.sh_window[first], self.sh_offset[first]
        self.pre_keys, self.pre_from = np.unique(self.keys[self.sh_key[first]], return_index=True)
        self.pre_to = np.append(self.pre_from[1:], len(first))

    @staticmethod
    def _places(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are in keys, and where: a bit table first, then a search."""
        if len(keys) == 0 or len(h) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(1 << 22, dtype=bool)
        shift = np.uint64(42)
        bits[keys >> shift] = True
        at = np.flatnonzero(bits[h >> shift])
        pos = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[pos] == h[at]
        return at[hit], pos[hit]

    def seen(self, w: shared.Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle) pairs in some documents, each once."""
        docs, found = [], []
        for size in self.sizes:
            at, key = self._places(shared.grams(w.hash, size), self.keys)
            ok = w.doc[at] == w.doc[at + size - 1]
            docs.append(w.doc[at[ok]])
            found.append(key[ok])
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(found)]), axis=1) if docs else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    def hits(self, w: shared.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence of a window in some documents."""
        ats, keys = [], []
        for size in self.sizes:
            at, key = self._places(shared.grams(w.hash, size), self.pre_keys)
            ats.append(at)
            keys.append(key)
        at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        many = (self.pre_to - self.pre_from)[key] if len(key) else key
        at = np.repeat(at, many)
        entry = np.repeat(self.pre_from[key], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) if len(at) else at
        window = self.pre_window[entry]
        start = at - self.pre_offset[entry]
        size = self.length[window]
        ok = (start >= 0) & (start + size <= len(w.hash))
        start, window, size = start[ok], window[ok], size[ok]
        ok = w.doc[start] == w.doc[start + size - 1]
        start, window, size = start[ok], window[ok], size[ok]
        ok = np.ones(len(start), dtype=bool)
        for j in range(self.window):
            place = np.minimum(start + j, len(w.hash) - 1)
            ok &= (j >= size) | (w.hash[place] == self.words[window, j])
        return start[ok], window[ok]


def _match(broadcast, id_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(broadcast.value)
        for batch in batches:
            for lo, hi, data, offsets in shared.pieces(batch.column(1)):
                w = shared.split_words(data, offsets, shared.PLAIN_WORDS)
                counts = w.per_doc(hi - lo)
                first = np.cumsum(counts) - counts
                start, window = windows.hits(w)
                marks = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + windows.length[window], -1)
                hit = np.cumsum(marks[:-1]) > 0
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                # A run of hit words ends where its text ends.
                doc_first = np.zeros(len(w.hash) + 1, dtype=bool)
                doc_first[first[counts > 0]] = True
                opens = np.flatnonzero(hit & ((edge[:-1] == 1) | doc_first[:-1]))
                closes = np.flatnonzero(hit & ((edge[1:] == -1) | doc_first[1:])) + 1
                span_doc = w.doc[opens] if len(opens) else opens
                items = np.unique(np.stack([w.doc[start], windows.owner[window]]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
                item_names = pa.array([windows.ids[i] for i in items[1]], pa.string())
                spans = pa.StructArray.from_arrays(
                    [pa.array(opens - first[span_doc], pa.int64()), pa.array(closes - first[span_doc], pa.int64())],
                    names=["first", "last"],
                )
                n = np.arange(hi - lo + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(span_doc, n), pa.int32()), spans),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(items[0], n), pa.int32()), item_names),
                    ],
                    names=["id", "n_words", "spans", "items"],
                )

    return run


def _count(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(broadcast.value)
        totals = np.zeros(len(windows.keys), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in shared.pieces(batch.column(0)):
                _, key = windows.seen(shared.split_words(data, offsets, shared.PLAIN_WORDS))
                totals += np.bincount(key, minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(totals[some], pa.int64())], names=["key", "n"])

    return run


def _row_key(id_: Column, text: Column) -> Column:
    """Name of a row by its text and id; equal for equal rows only, null apart from empty."""
    return F.concat(
        F.when(text.isNull(), "n").otherwise(F.md5(text.cast("binary"))), F.lit("|"), F.when(id_.isNull(), "n").otherwise(F.concat(F.lit("i"), id_.cast("string")))
    )


def _hits(docs: DataFrame, items: DataFrame, window: int, shingle: int, id_col: str, block_words: int) -> DataFrame:
    """``key, n_words, spans, items`` of every row; equal rows give equal results and stay as many as they were."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string")
    texts = docs.select(_row_key(F.col(id_col), text).alias("id"), text.alias("text"))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string"))
    size = named.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // block_words) + 1
    found = []
    for b in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).distinct().orderBy("item", "text").collect()
        windows = Windows([r[0] for r in part], [r[1] for r in part], window, shingle)
        sent = spark.sparkContext.broadcast(pickle.dumps(windows))
        counts = np.zeros(len(windows.keys), dtype=np.int64)
        if len(counts):
            for r in texts.select("text").mapInArrow(_count(sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
                counts[r["key"]] = r["n"]
        sent.unpersist()
        windows.order(counts)
        sent = spark.sparkContext.broadcast(pickle.dumps(windows))
        schema = "id string, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
        found.append(texts.mapInArrow(_match(sent, "string"), schema))
    if blocks == 1:
        return found[0].withColumnRenamed("id", "key")
    # Spans of different blocks may overlap: words are marked once per row.  Each block has every row once.
    out = cut_lineage(_union([f.withColumn("first_block", F.lit(b == 0)) for b, f in enumerate(found)]))
    out = out.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.array_sort(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count_if("first_block").alias("copies"),
    )
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias("key"), "n_words", _merged("spans").alias("spans"), "items")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document ``id_col, n_words, n_hit, spans`` (hit words, first to before last) and ``items`` (sorted ids).

    Null texts have no words.  An item without words has no window.  Every document row gives a row, also where ids repeat or are
    null, at any number of item blocks.  An empty table on either side gives no hits.  Other columns
    are left behind, whatever their names.  Item ids are read as strings; a repeated item id counts once.
    """
    out = _hits(docs, items, window, shingle, id_col, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    tail = F.substring("key", F.instr("key", "|") + 1, F.length("key"))
    own = F.when(tail.startswith("i"), F.substring(tail, F.lit(2), F.length(tail))).cast(docs.schema[id_col].dataType)
    return out.select(
        own.alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        "spans",
        F.array_sort(F.array_distinct("items")).alias("items"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merged(spans: str):
    """Sorted spans without overlap."""
    kind = "array<struct<first:bigint,last:bigint>>"

    def add(done, s):
        end = F.coalesce(F.element_at(done, -1)["last"], F.lit(0).cast("long"))
        fresh = F.struct(F.greatest(s["first"], end).alias("first"), s["last"].alias("last"))
        return F.when(s["last"] <= end, done).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(spans, F.array().cast(kind), lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(add(a, s)))


def clean(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The document rows that hold no window of any item, with their own columns.

    A row is judged by its own text: rows of one id, or of none, do not speak for each other.
    """
    found = _hits(docs, items, window, shingle, id_col, block_words).filter(F.size("spans") > 0)
    bad = found.select(F.col("key").alias("_bad_key")).distinct()
    return docs.join(bad, _row_key(docs[id_col], docs["text"].cast("string")) == bad["_bad_key"], "left_anti")
