"""Scalar column functions, all built from JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import config

PROBABILITY_FLOOR = 1e-15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conform(c: Column | str, domain: Sequence[str]) -> Column:
    """The value if it belongs to the closed domain, otherwise null."""
    c = _col(c)
    return F.when(c.isin(list(domain)), c)


def domain_code(c: Column | str, domain: Sequence[str]) -> Column:
    """Zero-based place of the value in the domain, null outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in domain]), _col(c))
    return F.when(place > 0, (place - 1).cast("int"))


def in_span(c: Column | str, start, end) -> Column:
    """Half-open interval test ``start <= c < end``."""
    c = _col(c)
    return (c >= start) & (c < end)


def span_name(c: Column | str, spans: dict[str, tuple[int, int]]) -> Column:
    """Name of the (disjoint) span that holds the value, null when none does."""
    out = None
    for name, (start, end) in spans.items():
        test = in_span(c, start, end)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def cost_weight(label: Column | str, cost: Column | float) -> Column:
    """Instance weight: the cost ratio for negatives, 1 for positives."""
    cost = F.lit(cost) if isinstance(cost, (int, float)) else cost
    return F.when(_col(label) == 0, cost).otherwise(F.lit(1.0))


def binarize(c: Column | str, threshold, strict: bool = False) -> Column:
    """1 where the score reaches (``>=``) or, when strict, exceeds (``>``) the threshold."""
    c = _col(c)
    return (c > threshold if strict else c >= threshold).cast("int")


def is_correct(decision: Column | str, label: Column | str) -> Column:
    return (_col(decision) == _col(label)).cast("int")


def self_confidence(p: Column | str) -> Column:
    """A classifier's own chance of being right: ``max(p, 1 - p)``."""
    p = _col(p)
    return F.greatest(p, F.lit(1.0) - p)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def log_odds(p: Column | str) -> Column:
    p = _col(p)
    return F.ln(p / (F.lit(1.0) - p))


def shifted_probability(raw: Column | str, offset) -> Column:
    """Probability of a raw score after adding a log-odds offset."""
    return sigmoid(_col(raw) + offset)


def clipped(p: Column | str, floor: float = PROBABILITY_FLOOR) -> Column:
    return F.least(F.greatest(_col(p), F.lit(floor)), F.lit(1.0 - floor))


def na_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit("NA"))


def unit_vector(v: Column | str) -> Column:
    """The array scaled to Euclidean length 1; null for a zero vector."""
    v = F.transform(_col(v), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def ratio(num: Column, den: Column) -> Column:
    """Quotient of two counts, null when the denominator is 0."""
    return num.cast("double") / F.nullif(den, F.lit(0).cast("long")).cast("double")


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    c = _col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def scenario_fields(name: Column | str) -> dict[str, Column]:
    """Attributes encoded in ``alert_0.05-data_0.05[-sub_0.50][-l_0.057]``."""
    name = _col(name)

    def number(tag: str) -> Column:
        return F.nullif(F.regexp_extract(name, rf"(?:^|-){tag}_([0-9.]+)", 1), F.lit("")).cast("double")

    return {
        "alert_rate": number("alert"),
        "data_rate": number("data"),
        "sub": F.coalesce(number("sub"), F.lit(1.0)),
        "cost": number("l"),
    }


def environment_fields(env: Column | str) -> dict[str, Column]:
    """Capacity distribution and its seed from ``<name>#variable-3_...`` or ``<name>#homogenous_...``."""
    head = F.split(F.split(_col(env), "#")[1], "_")[0]
    even = head == "homogenous"
    return {
        "distribution": F.when(even, "homogenous").otherwise("variable"),
        "distribution_std": F.when(~even, config.RUN_VARIABLE_STD),
        "distribution_seed": F.when(~even, F.try_element_at(F.split(head, "-"), F.lit(2))),
    }


def training_seed(name: Column | str) -> Column:
    """The first two ``#`` fields of a training-set name."""
    return F.substring_index(_col(name), "#", 2)


def mean_ci_text(mean: Column | str, half_width: Column | str, digits: int = 2) -> Column:
    """Report cell ``mean +- half width``."""
    fmt = f"%.{digits}f"
    return F.format_string(
        f"{fmt} +- {fmt}", F.bround(_col(mean), digits), F.bround(_col(half_width), digits)
    )
