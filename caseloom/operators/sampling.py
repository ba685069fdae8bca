"""Exact-size samples drawn by a seeded hash order, equal on every engine, retry and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions.hashing import HASH_SPAN, seeded_hash, uniform_cuts
from caseloom.operators import ordering
from caseloom.operators.joins import attach
from caseloom.session import cut_lineage, shuffle_width

DRAWS_PER_CHUNK = 10_000
#: Standard deviations by which a cut of the hash range keeps more rows than asked for.
HEADROOM = 6.0


def hash_rank(rows: DataFrame, keys: Sequence[str], seed, key: str, out: str) -> DataFrame:
    """Zero-based place of each row in the seeded order of its stratum."""
    n = min(ordering.MAX_BUCKETS, 2 * shuffle_width(rows.sparkSession))
    hashed = rows.withColumn("_h", seeded_hash(seed, key))
    return ordering.numbered(hashed, keys, "_h", out, ties=[key], cuts=uniform_cuts(n)).drop("_h")


def smallest(rows: DataFrame, group: Sequence[str], asked: DataFrame, seed, key: str) -> DataFrame:
    """The ``n_take`` rows of least hash of each group, with ``asked(group, n_take, _have)`` naming every group to take from.

    A cut of the hash range keeps little more than is asked for, so only that is ordered.  Groups in which the cut kept too few are
    taken whole and ordered again: the rows are the same as those of an order of everything.
    """
    group = list(group)
    asked = cut_lineage(asked.select(*group, "n_take", "_have"))
    want = F.col("n_take") + F.lit(HEADROOM) * F.sqrt(F.col("n_take").cast("double")) + HEADROOM
    share = F.least(want / F.greatest(F.col("_have"), F.lit(1)), F.lit(1.0))
    hashed = attach(rows.withColumn("_h", seeded_hash(seed, key)), asked, group, key, written=True)
    near = cut_lineage(hashed.filter(F.col("_h") <= F.ceil(share * HASH_SPAN)))
    got = near.groupBy(*group).agg(F.count(F.lit(1)).alias("_got"))
    short = ordering.null_safe_join(asked, got, group, "left").filter(F.coalesce("_got", F.lit(0)) < F.col("n_take"))
    if not short.isEmpty():
        short = cut_lineage(short.select(*group))
        kept = ordering.null_safe_join(near, short, group, "left_anti")
        near = kept.unionByName(attach(hashed, short, group, key, "left_semi", written=True))
    n = min(ordering.MAX_BUCKETS, 2 * shuffle_width(rows.sparkSession))
    ranked = ordering.numbered(near, group, "_h", "_rank", ties=[key], cuts=uniform_cuts(n))
    return ranked.filter(F.col("_rank") < F.col("n_take")).drop("_rank", "_h", "n_take", "_have")


def stratified_sample(
    rows: DataFrame, keys: Sequence[str], stratum: str, sizes: DataFrame, seed, key: str = "case_id"
) -> DataFrame:
    """Exactly ``n_take`` rows per (keys, stratum); fails when a stratum has fewer.

    ``sizes`` has one row per stratum.  Strata missing from it are left out.  ``rows`` should be a written table: they are read
    once for the counts and once for the cut.
    """
    group = [*keys, stratum]
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_have"))
    sized = ordering.null_safe_join(sized, sizes, [stratum])
    short = F.concat(F.lit("stratum too small: "), F.to_json(F.struct(*group, "_have", "n_take")))
    enough = F.when(F.col("_have") >= F.col("n_take"), F.col("n_take")).otherwise(F.raise_error(short).cast("long"))
    return smallest(rows, group, sized.withColumn("n_take", enough), seed, key)


def nested_subsample(
    rows: DataFrame,
    keys: Sequence[str],
    stratum: str,
    shares: Sequence[float],
    seed,
    key: str = "case_id",
    keep_whole=config.KEEP_WHOLE_MONTH,
) -> DataFrame:
    """The sample itself (``sub`` = 1) and ``floor(size * share)`` rows of each stratum per share.

    ``keep_whole`` names the stratum that every share keeps in full.
    """
    keys = list(keys)
    ranked = hash_rank(rows, [*keys, stratum], f"{seed}-sub", key, "_rank")
    sized = rows.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("_size"))
    listed = F.array(*[F.lit(1.0), *[F.lit(float(s)) for s in shares]])
    in_share = F.filter(
        listed,
        lambda s: (s == 1.0)
        | (F.col(stratum) == keep_whole)
        | (F.col("_rank") < F.floor(F.col("_size").cast("double") * s)),
    )
    return attach(ranked, sized, [*keys, stratum], key).withColumn("sub", F.explode(in_share)).drop("_rank", "_size")


def draws(groups: DataFrame, n: str, out: str = "draw") -> DataFrame:
    """Rows 0..n-1 for every group, built in chunks so that no task holds a long array."""
    chunks = F.ceil(F.col(n) / DRAWS_PER_CHUNK).cast("long")
    cut = groups.filter(F.col(n) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    # Dealt by group and chunk: many small groups and one large group both spread.
    cut = cut.repartition(*groups.columns, "_chunk")
    first = F.col("_chunk") * DRAWS_PER_CHUNK
    last = F.least(first + DRAWS_PER_CHUNK, F.col(n).cast("long")) - 1
    return cut.withColumn(out, F.explode(F.sequence(first, last))).drop("_chunk")


def oversample_positives(
    rows: DataFrame, keys: Sequence[str], label: str, n_pos: DataFrame, seed, key: str = "case_id"
) -> DataFrame:
    """All negatives and exactly ``n_pos`` positives drawn with replacement, as ``copies`` per row.

    ``n_pos`` has one row per group.  A row with ``copies`` = 3 stands for three equal rows;
    :func:`expand_copies` writes them out.
    """
    keys = list(keys)
    negatives = rows.filter(F.col(label) == 0).withColumn("copies", F.lit(1).cast("long"))
    positives = ordering.numbered(rows.filter(F.col(label) == 1), keys, key, "_slot")
    have = positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    asked = ordering.null_safe_join(have, n_pos, keys) if keys else have.withColumn("n_pos", n_pos.select("n_pos").scalar())
    slot = F.pmod(seeded_hash(seed, "draw"), F.col("_have"))
    drawn = (
        draws(asked, "n_pos")
        .withColumn("_slot", slot)
        .groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return negatives.unionByName(ordering.null_safe_join(positives, drawn, [*keys, "_slot"]).drop("_slot"))


def expand_copies(rows: DataFrame) -> DataFrame:
    """One row per copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
