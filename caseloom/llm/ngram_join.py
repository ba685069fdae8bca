"""N-gram Jaccard join: documents whose word shingle sets have a Jaccard similarity of at least ``percent``.

Shingles are ordered by rarity (a class of a corpus count, then hash); a prefix is long enough that two similar
sets share ``1 + size // 64`` prefix shingles at least.

1. Documents of equal sets are collapsed to the smallest id.
2. Of those, documents with identical prefixes and size form a group.  Group prefixes are joined to the group
   that holds the shingle and shares most shingles with others, under the length and positional filters and the number of shared prefix
   shingles; groups are expanded and each member verified against the first document.  Families of copies become one
   component here with one comparison a member.
3. Prefix rows are reduced to kinds, one per (shingle, component, size, place), with the bits that all and any of
   their members have in a folded signature.  Kinds of different components meet under the length filter, the
   positional filter at the first shared shingles and the least number of different bits; the rest are expanded to their members and
   verified, so no link between components is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shared
from caseloom.llm.components import components
from caseloom.session import cut_lineage, ship_package, shuffle_width

#: Bounds of the rarity table (a byte a slot, sent to every task) and shingles per slot between them.
LEAST_SLOTS, MOST_SLOTS, PER_SLOT = 1 << 16, 1 << 24, 512
CANDIDATE_BITS = 1 << 21
SHARED_EVERY = 64
#: 64-bit parts of the parity signature: each shingle in one set but not the other flips at most one of its bits.
PARTS = 8
SIGNATURE = [f"s{k}" for k in range(PARTS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) pairs of a piece, each once, sorted; a text of under k words has one shingle of all."""
    w = shared.split_words(data, offsets, shared.SPACE_WORDS)
    n = len(offsets) - 1
    counts = w.per_doc(n)
    first = np.cumsum(counts) - counts
    h = shared.grams(w.hash, k)
    ok = w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    docs, hashes = [w.doc[: len(h)][ok]], [h[ok]]
    for size in range(1, k):
        at = np.flatnonzero(counts == size)
        if len(at):
            docs.append(at)
            hashes.append(shared.combine([w.hash[first[at] + j] for j in range(size)]))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _slot_counts(k: int, slots: int):
    block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in shared.pieces(batch.column(0)):
                _, h = shingle_sets(data, offsets, k)
                totals += np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        if totals.any():
            rows = totals.reshape(-1, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["block", "counts"],
            )

    return run


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("counts"))
    classes = np.minimum(255, 8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"block": table.column("block")[:1], "counts": pa.array([classes.tobytes()], pa.binary())})


def rarity(texts: DataFrame, k: int) -> np.ndarray:
    """Class of the number of shingles in each slot of the hash, over all documents."""
    words = texts.select(F.sum(F.length("text") / 6)).first()[0] or 0
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, words / PER_SLOT):
        slots *= 2
    schema = "block int, counts binary"
    parts = texts.select("text").mapInArrow(_slot_counts(k, slots), schema).groupBy("block").applyInArrow(_sum_blocks, schema)
    out = np.zeros(slots, dtype=np.uint8)
    for block, c in parts.collect():  # bounded by MOST_SLOTS bytes
        out[block * 4096 : block * 4096 + 4096] = np.frombuffer(bytes(c), np.uint8)
    return out


def _sketch(k: int, percent: int, classes):
    """Size, two set hashes and the ordered prefix of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            for lo, hi, data, offsets in shared.pieces(batch.column(1)):
                m = hi - lo
                doc, h = shingle_sets(data, offsets, k)
                n = np.bincount(doc, minlength=m)
                first = np.cumsum(n) - n
                sums = np.zeros((2, m), dtype=np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    sums[0, full] = np.add.reduceat(h, first[full])
                    sums[1, full] = np.add.reduceat(shared.mix(h + np.uint64(77)), first[full])
                bit = doc * (64 * PARTS) + (h >> np.uint64(64 - (64 * PARTS - 1).bit_length())).astype(np.int64)
                odd = (np.bincount(bit, minlength=m * 64 * PARTS) & 1).astype(np.uint8)
                signature = np.packbits(odd).reshape(m, 8 * PARTS).view(np.int64)
                by = np.lexsort((h, table[(h & np.uint64(len(table) - 1)).astype(np.int64)], doc))
                h = h[by]
                rank = np.arange(len(h)) - first[doc]
                size = prefix_size(n, percent)
                part = h[rank < size[doc]]
                edges = np.concatenate([[0], np.cumsum(np.minimum(size, n))])
                raw = part.tobytes()
                prefix = [raw[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, m),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0].view(np.int64), pa.int64()),
                        pa.array(sums[1].view(np.int64), pa.int64()),
                        pa.array(prefix, pa.binary()),
                        *[pa.array(np.ascontiguousarray(signature[:, k]), pa.int64()) for k in range(PARTS)],
                    ],
                    names=["doc", "n", "k1", "k2", "prefix", *SIGNATURE],
                )

    return run


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1 + n // SHARED_EVERY


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (t, i, n, g) per prefix shingle; i counts from 1."""
    for batch in batches:
        size = np.array([len(b) // 8 for b in batch.column(2).to_pylist()], dtype=np.int64)
        t = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        first = np.cumsum(size) - size
        for a in range(0, len(t), 500_000):
            own = np.repeat(np.arange(len(size)), size)[a : a + 500_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t[a : a + 500_000], pa.int64()),
                    pa.array(np.arange(a, a + len(own)) - first[own] + 1, pa.int32()),
                    batch.column(1).take(pa.array(own)).cast(pa.int32()),
                    batch.column(0).take(pa.array(own)),
                ],
                names=["t", "i", "n", "g"],
            )


def _may_match(a: str, b: str, percent: int) -> Column:
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent})"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" AND {a}.n - {a}.i + {b}.n - {b}.i >= 0"
        f" AND least({a}.i, {b}.i) + least({a}.n - {a}.i, {b}.n - {b}.i) >= {need}"
    )


def _may_start(a: str, b: str, percent: int) -> Column:
    """The two prefix rows may be among the first ``1 + size // 64`` shared shingles of a similar pair.

    What is shared is at most that many plus the shingles behind.  The first ones of a similar pair all lie in both
    prefixes and pass, so a count of the passing rows still finds it.
    """
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent})"
    so_far = f"least({a}.i, {b}.i, 1 + least({a}.n, {b}.n) div {SHARED_EVERY})"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" AND {so_far} + least({a}.n - {a}.i, {b}.n - {b}.i) >= {need}"
    )


def _differing(percent: int, n: str, n2: str, every: str, some: str, every2: str, some2: str) -> Column:
    """Bits that all of one side and none of the other have leave room for similar sets of ``n`` and ``n2`` shingles."""
    bits = f"bit_count(({every} & ~{some2}) | ({every2} & ~{some}))"
    return F.expr(f"{bits} <= {n} + {n2} - 2 * ceil({percent} * ({n} + {n2}) / {100 + percent})")


def _near(x: str, y: str, percent: int) -> Column:
    """The signatures of two documents allow as many shared shingles as similar sets of their sizes have."""
    flips = " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in SIGNATURE)
    return F.expr(f"{flips} <= {x}.n + {y}.n - 2 * ceil({percent} * ({x}.n + {y}.n) / {100 + percent})")


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as similar sets must."""
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("least_n").alias("m"))
    return pairs.filter(F.expr(f"shared >= 1 + m div {SHARED_EVERY}")).select("a", "b")


def _sets_of(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[np.asarray(batch.column(1)) & (len(wanted) - 1)]))
            for lo, hi, data, offsets in shared.pieces(batch.column(2)):
                doc, h = shingle_sets(data, offsets, k)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                raw = h.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc", "set"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that are similar; only sets of documents in pairs are shuffled."""
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct().withColumn("h", F.xxhash64("doc"))
    bits = spark.sparkContext.broadcast(shared.bit_table(ends, "h", CANDIDATE_BITS))
    sets = texts.select("doc", F.xxhash64("doc").alias("h"), "text").mapInArrow(_sets_of(k, bits), "doc long, set binary")
    sets = cut_lineage(sets.join(ends.select("doc"), "doc", "left_semi").dropDuplicates(["doc"]))
    first = sets.select(F.col("doc").alias("a"), F.col("set").alias("x"))
    second = sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_similar(percent), "a long, b long")


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every document.

    Ids must be integers.  Null and empty texts have no shingles and stay alone, as do documents without an id (whose
    component is null).  Rows repeated with one id and text repeat in the result; an empty table gives none; other
    columns are left behind.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    classes = spark.sparkContext.broadcast(rarity(texts, k).tobytes())
    schema = "doc long, n long, k1 long, k2 long, prefix binary, " + ", ".join(f"{x} long" for x in SIGNATURE)
    sketch = cut_lineage(texts.mapInArrow(_sketch(k, percent, classes), schema))
    full = sketch.filter("n > 0 AND doc IS NOT NULL")
    equal = cut_lineage(full.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep")))
    reps = full.join(equal.select("n", "k1", "k2", F.col("rep").alias("doc")), ["n", "k1", "k2", "doc"], "left_semi")
    reps = reps.dropDuplicates(["doc"]).withColumn("p", F.xxhash64("prefix"))
    reps = cut_lineage(reps.select("doc", "n", "prefix", "p", *SIGNATURE))

    groups = reps.groupBy("n", "p").agg(F.min("doc").alias("g"))
    members = cut_lineage(reps.select("doc", "n", "p").join(groups, ["n", "p"]).select("doc", "g"))
    heads = reps.join(members.filter("doc = g").select("doc"), "doc", "left_semi").select("doc", "n", "prefix")
    rows = heads.mapInArrow(_prefix_rows, "t long, i int, n int, g long")
    rows = cut_lineage(rows.withColumn("many", F.expr("count(*) OVER (PARTITION BY t)")).filter("many > 1"))
    # The text that copies were made from shares more shingles than any copy does: it leads.
    hubs = rows.groupBy("g").agg(F.sum("many").alias("hub"))
    led = rows.join(hubs, "g").withColumn("first", F.expr("min(struct(-hub AS hub, g, n, i)) OVER (PARTITION BY t)"))
    led = led.filter("g <> first.g").alias("b").filter(_may_match("b", "first", percent))
    led = led.select(F.col("first.g").alias("a"), F.col("g").alias("b"), F.expr("least(n, first.n) AS least_n"))
    led = _enough(led)
    expanded = led.join(members.withColumnRenamed("g", "b"), "b").select("a", F.col("doc").alias("b"))
    within = members.filter("doc <> g").select(F.col("g").alias("a"), F.col("doc").alias("b"))
    pairs = cut_lineage(expanded.union(within).distinct())
    links = cut_lineage(verified(pairs, texts, k, percent))
    labels = components(links)

    # Members of a group have equal prefixes, so each prefix row stands for all of them.
    member = members.join(labels.withColumnRenamed("v", "doc"), "doc", "left").select("doc", "g", F.coalesce("c", "doc").alias("c"))
    member = cut_lineage(member.join(reps.select("doc", "n", *SIGNATURE), "doc"))
    own = rows.select("t", "i", "g").join(member, "g").withColumn("f", F.expr(" ^ ".join(SIGNATURE)))
    kinds = own.groupBy("t", "i", "n", "c").agg(F.bit_and("f").alias("every"), F.bit_or("f").alias("some"))
    kinds = cut_lineage(kinds)
    left, right = kinds.alias("a"), kinds.alias("b")
    apart = _differing(percent, "a.n", "b.n", "a.every", "a.some", "b.every", "b.some")
    met = left.join(right, F.expr("a.t = b.t AND a.c < b.c") & _may_start("a", "b", percent) & apart)
    met = met.select(
        *[F.col(f"a.{x}").alias(x) for x in ("t", "c", "n", "i")],
        *[F.col(f"b.{x}").alias(f"{x}2") for x in ("c", "n", "i", "every", "some")],
    )
    m, x = met.alias("m"), own.drop("g").alias("x")
    member_of = F.expr("m.t = x.t AND m.c = x.c AND m.n = x.n AND m.i = x.i")
    one = m.join(x, member_of & _differing(percent, "x.n", "m.n2", "x.f", "x.f", "m.every2", "m.some2"))
    one = one.select("x.*", "m.c2", "m.n2", "m.i2").alias("x")
    two = own.drop("g").alias("y")
    same = F.expr("x.t = y.t AND x.c2 = y.c AND x.n2 = y.n AND x.i2 = y.i")
    cross = one.join(two, same & _near("x", "y", percent))
    cross = _enough(cross.select(F.expr("x.doc AS a"), F.expr("y.doc AS b"), F.expr("least(x.n, y.n) AS least_n")))
    # Different members of one group that its first document did not link.
    mixed = member.alias("x").join(member.alias("y"), F.expr("x.g = y.g AND x.c < y.c") & _near("x", "y", percent))
    cross = cross.union(mixed.select(F.expr("x.doc AS a"), F.expr("y.doc AS b")))
    pairs = cut_lineage(cross.distinct())
    if not pairs.isEmpty():
        more = verified(pairs, texts, k, percent)
        labels = components(links.unionByName(more))

    linked = equal.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    linked = linked.select("n", "k1", "k2", F.coalesce("c", "rep").alias("c"))
    out = sketch.select("doc", "n", "k1", "k2").join(linked, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("c", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The document of the smallest id of each group, with its own columns, whatever their names; documents alone stay.

    Null, empty and repeated rows as in :func:`similar_groups`: those without shingles or id stay, rows of one id stay or go together.
    """
    (leaves,) = shared.unused(docs, "_gone")
    groups = similar_groups(docs, k, percent, id_col)
    gone = groups.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).cast("long").alias(leaves)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(leaves), "left_anti")
