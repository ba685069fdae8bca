"""Mixing to target weights: soft domain membership and nonnegative rates by projected-gradient least squares.

A classifier fitted on the labelled table gives every document a posterior over the domains.  Rates x solve
``min |sum_i x_i t_i p_i - b|`` over x >= 0, with t_i the tokens and p_i the posterior of document i and b the target
tokens of the domains; among the rates that do, those nearest to 1 are taken, through a small term ``t_i (x_i - 1)^2``.
Every step moves the rate of document i along its gradient, by p_i . (b - sum x t p) / L, and cuts it at zero.  The moves
are added up before the cut (lazy projection), so the state of all documents is one number per domain and the
rates are max(0, 1 + p_i . moved).  L is the largest eigenvalue of sum t p p' over all documents, formed once: documents
at zero only lower it, so this step length is always safe.
Steps are accelerated, with a new start where the momentum points away.  Each step is one sum over
all documents, and only numbers per domain reach the driver.  All work on rows is done by built-in expressions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.shared import unused, words_expr
from caseloom.session import cut_lineage

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.08, "toxic": 0.02}
#: Labelled documents the classifier learns from, at most: those of the smallest hashed ids.
LABELLED_ROWS = 20_000
#: Words the classifier keeps, and slots of the table that holds them; both fixed bounds.
FEATURES, SLOTS = 256, 1 << 12
#: Likelihood-ratio evidence a word must give in all labelled documents to be kept.
LEAST_GAIN = 10.0
#: A word is kept if its share in some domain is at least twice that in all: weaker ones tell of length and language only.
LEAST_WEIGHT = math.log(2)
#: Words of a document that count as evidence at full weight.
EVIDENCE = 40
STEPS, TOLERANCE = 100, 1e-6
#: Weight of the nearness to 1 against the distance from the targets.
NEAR = 1e-6


def domain_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from 0/1 labels; rows without an id or a quality are left out, repeated ids count once."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("poor")
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic = 1)")
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).select("doc_id", domain.alias("domain"))


def _features(text: Column) -> Column:
    """Distinct hashed words; runs of punctuation count as words."""
    return F.array_distinct(F.transform(words_expr(F.regexp_replace(text.cast("string"), r"([!-/:-@\[-`{-~]+)", " $1 ")), lambda w: F.xxhash64(w)))


def fit_classifier(docs: DataFrame, labels: DataFrame) -> dict:
    """Naive Bayes on the most telling words: log weight of a word's presence, log score of a domain where all are absent."""
    chosen = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    seen = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("domain", _features(F.col("text")).alias("h"))
    seen = cut_lineage(seen)
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = {d: sizes.get(d, 0) for d in DOMAINS}
    total = sum(n.values())
    counts = seen.select("domain", F.explode("h").alias("h")).groupBy("h")
    counts = counts.agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    # Smoothed share of documents with the word in each domain against the share in all.
    share = {d: (F.col(d) + 1.0) / (n[d] + 2.0) for d in DOMAINS}
    mean = (sum(F.col(d) for d in DOMAINS) + 1.0) / (total + 2.0)
    weight = {d: F.log(share[d] / mean) for d in DOMAINS}
    gain = sum(F.col(d) * weight[d] for d in DOMAINS)
    absent = {d: F.log(1.0 - share[d]) for d in DOMAINS}
    values = [F.round(v, 6).alias(name) for d in DOMAINS for name, v in ((d, weight[d] - absent[d]), (f"no_{d}", absent[d]))]
    best = counts.select("h", *values, F.round(gain, 9).alias("gain"), F.greatest(*weight.values()).alias("most"))
    best = best.filter((F.col("gain") >= LEAST_GAIN) & (F.col("most") >= LEAST_WEIGHT)).orderBy(F.desc("gain"), "h").limit(FEATURES).collect()
    kept = {r["h"] & (SLOTS - 1): r for r in reversed(best)}  # on one slot the more telling word stays
    hashes = [kept[k]["h"] if k in kept else None for k in range(SLOTS)]
    table = {d: [kept[k][d] if k in kept else 0.0 for k in range(SLOTS)] for d in DOMAINS}
    priors = {d: math.log((n[d] + 1.0) / (total + len(DOMAINS))) for d in DOMAINS}
    bases = {d: priors[d] + math.fsum(r[f"no_{d}"] for r in kept.values()) for d in DOMAINS}
    return {"hashes": hashes, "weights": table, "bases": bases}


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, tokens`` and a probability per domain, ``p_<domain>``."""
    hashes = F.from_json(F.lit(json.dumps(model["hashes"])), "array<bigint>")
    place = lambda h: h.bitwiseAND(SLOTS - 1).cast("int")
    rows = docs.select(
        "doc_id",
        F.size(words_expr(F.col("text").cast("string"))).cast("long").alias("tokens"),
        F.filter(_features(F.col("text")), lambda h: F.get(hashes, place(h)) == h).alias("h"),
    )
    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("h"), F.lit(1)))
    scores = {}
    for d in DOMAINS:
        table = F.from_json(F.lit(json.dumps(model["weights"][d])), "array<double>")
        total = F.aggregate("h", F.lit(0.0), lambda a, h: a + F.get(table, place(h)))
        scores[f"s_{d}"] = F.coalesce(total, F.lit(0.0)) * F.coalesce(scale, F.lit(1.0)) + model["bases"][d]
    rows = rows.withColumns(scores)
    top = F.greatest(*[F.col(f"s_{d}") for d in DOMAINS])
    rows = rows.withColumns({f"e_{d}": F.exp(F.col(f"s_{d}") - top) for d in DOMAINS})
    norm = sum(F.col(f"e_{d}") for d in DOMAINS)
    return rows.select("doc_id", "tokens", *[(F.col(f"e_{d}") / norm).alias(f"p_{d}") for d in DOMAINS])


@dataclass(frozen=True)
class Rates:
    """Result of the steps: accumulated move per domain, divisor of all rates, number of steps, distance from the targets in tokens, and whether that is within tolerance."""

    moved: tuple[float, ...]
    divisor: float
    steps: int
    miss: float
    converged: bool

    def column(self) -> Column:
        p = [F.col(f"p_{d}") for d in DOMAINS]
        return _rate(p, self.moved) / self.divisor


def _rate(p: list[Column], moved) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) + sum(q * float(v) for q, v in zip(p, moved)))


def solve_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None) -> Rates:
    """Rates of the rows of ``doc_id, tokens, p_*``.

    ``budget`` is the number of tokens to reach.  By default it is the one that asks of the first domain just what it
    has, and rates are raised together, which keeps all shares, until a document wholly of that domain has 1 at least.
    Of all rates stepped through, those that miss the targets least are returned.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    t = F.coalesce("tokens", F.lit(0)).cast("double")
    rows = members.select(t.alias("t"), *p)
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    first = [v or 0.0 for v in rows.agg(*[F.sum(F.col("t") * q) for q in p], *[F.sum(F.col("t") * p[i] * p[j]) for i, j in pairs]).first()]
    mass = np.array(first[: len(p)])
    gram = np.zeros((len(p), len(p)))
    for (i, j), v in zip(pairs, first[len(p) :]):
        gram[i, j] = gram[j, i] = v

    def mass_under(moved: np.ndarray) -> np.ndarray:
        """Tokens of each domain under the rates."""
        weighed = rows.withColumn("t", F.col("t") * _rate(p, moved))
        return np.array([v or 0.0 for v in weighed.agg(*[F.sum(F.col("t") * q) for q in p]).first()])

    share = np.array([targets[d] for d in DOMAINS], dtype=float)
    share = share / share.sum()
    total = budget if budget is not None else mass[0] / share[0] if share[0] > 0 else mass.sum()
    want = share * total
    largest = float(np.linalg.eigvalsh(gram)[-1])
    near = NEAR * largest
    moved = ahead = best = np.zeros(len(p))
    miss, steps, pace = float(np.linalg.norm(want - mass)), 0, 1.0
    within = TOLERANCE * max(total, 1.0)
    while miss > within and largest > 0 and steps < STEPS:
        left = want - mass - near * ahead
        step = ahead + left / (largest + near)
        if left @ (step - moved) < 0:
            pace = 1.0
        faster = (1.0 + math.sqrt(1.0 + 4.0 * pace * pace)) / 2.0
        ahead = step + (step - moved) * ((pace - 1.0) / faster)
        moved, pace, steps = step, faster, steps + 1
        mass = mass_under(ahead)
        if (now := float(np.linalg.norm(want - mass))) < miss:
            best, miss = ahead, now
    whole = 1.0 + float(best[0])
    raised = budget is None and share[0] > 0 and 0 < whole < 1
    return Rates(tuple(float(v) for v in best), whole if raised else 1.0, steps, miss, miss <= within)


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None) -> Column:
    """Rate of each row of ``doc_id, tokens, p_*`` as an expression, see :func:`solve_rates`."""
    return solve_rates(members, targets, budget).column()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """Per document ``doc_id, tokens, p_<domain>, rate``.

    Null and empty texts have no tokens and the posterior of a text without telling words; their rate follows from it like any other.
    Without labels all domains are equally likely.  Rows are independent and may repeat; an empty table gives none.
    Targets that no rates can meet (a domain without tokens, posteriors that are all mixed) are approached as far as
    rates can come, in ``STEPS`` steps at most.
    """
    members = cut_lineage(posteriors(docs, fit_classifier(docs, labels)))
    return members.withColumn("rate", fit_rates(members, targets, budget))


def copies(rate: str = "rate", id_col: str = "doc_id") -> Column:
    """Whole copies whose expected number is the rate, fixed by the id."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003.0
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """Documents with ``rate`` and ``copies``; those with no copy leave.

    Columns of these two names are replaced, all others stay.
    """
    (key,) = unused(docs, "_id")
    rates = mix(docs, labels, targets, budget).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias(key), "rate")
    own = docs.drop("rate", "copies")
    out = own.join(rates, own["doc_id"].eqNullSafe(rates[key])).drop(key)
    return out.withColumn("copies", copies()).filter("copies > 0")
