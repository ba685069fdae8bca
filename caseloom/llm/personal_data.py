"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans follow fixed formats (email, ip, card, phone) and always stay.  Candidates for more are spans of a looser
pattern outside them: addresses in words, national phone numbers, card-like numbers, IPv6, ids, secrets, names after a title.
Five labelers (two of regular expressions, a gazetteer, the words before, the neighbours) vote yes, no or nothing
on every base span and candidate of the corpus.  Equal votes are counted in Spark, so the expectation-maximisation sees
at most ``3 ** 5`` rows a kind whatever the size of the corpus; it estimates what each labeler's votes are worth and how
likely each combination of votes is a true span.  These likelihoods are the soft labels of a naive Bayes classifier on
the shape and surroundings of a span, which never sees the votes; its table has a few hundred rows.  A candidate it trusts becomes a span.

All of it are expressions on the row of a document: no user functions, no shuffle of texts, no join back.  Quantifiers are possessive or
bounded, and start where a run starts, so very long texts cost linear time and no stack.

Rows and results.  A null text is empty.  Every row gives a row with all its columns; columns of the result replace
columns of the same name.  Ids are not read: they may repeat or be null.  Empty tables give no rows.  Positions
are code points, ends exclusive.  Spans of one kind never overlap; base spans of different kinds may, others overlap nothing.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import cut_lineage

#: Kinds in the order of the result; the first four have base formats.
KINDS = ["email", "ip", "card", "phone", "id", "name", "secret"]
BASE_KINDS = KINDS[:4]

#: Base formats; a run of characters that fails at its start fails anywhere inside, so it is tried once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Sr Sra Mme Madame Monsieur".split()
_TITLE = rf"(?:{'|'.join(TITLES)})"
_SECRET = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
_SECRET_LEAD = r"^[^=:]*[=:]\s{0,3}[\"']?"
#: Looser pattern of all kinds; alternatives do not overlap, the leftmost wins.
LOOSE = "|".join(
    [
        rf"\b(?i:{_SECRET})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_.=~-]{{8,256}}",
        r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,5}",
        r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
        BASE["ip"],
        BASE["card"],
        r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[2-9][0-9]{2})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        rf"\b{_TITLE}\.? \p{{Lu}}[\p{{L}}'-]{{1,30}}(?: \p{{Lu}}[\p{{L}}'-]{{1,30}})?",
    ]
)
_MASK = "\ue000"

#: Gazetteers: fixed values.
ENDINGS = "com org net edu gov info biz io de fr es uk it nl at ch eu us ca br in jp cn au ru pl".split()
FILE_ENDINGS = "png jpg jpeg gif svg js css html php py java md txt zip exe".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 61 62 63 64 65 81 82 84 86 90 91".split()
GIVEN_NAMES = (
    "Anna Maria Peter Paul John James Mary Robert Michael David Thomas Daniel Laura Julia Jean Pierre Marie Claire Hans"
    " Klaus Ursula Sabine Juan Carlos Ana Luis Elena Sofia Martin Eva"
).split()
ACCOUNT_LANDS = "DE FR ES GB IT NL AT CH BE PT PL SE NO DK FI IE LU".split()
PLACEHOLDERS = "example|changeme|password|placeholder|your|dummy|xxxx|test"
#: Words before a span that speak for a kind, and words that speak against all kinds.
CUES = {
    "email": r"mail|contact|write to|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": r"card|visa|master|karte|tarjeta|carte|payment",
    "phone": r"tel|phone|call|fax|mobile|cell|handy|móvil|appel",
    "id": r"iban|ssn|social|account|konto|cuenta|passport",
    "name": rf"{_TITLE}\.? $",
    "secret": rf"(?i:{_SECRET})",
}
ANTI_CUES = r"version|isbn|issn|\bpage|fig\.|figure|chapter|section|serial|build|order|sku|invoice|\bpp?\.|§"

LABELERS = ["format", "variety", "gazetteer", "words_before", "neighbours"]
#: A candidate becomes a span from this probability on.
TRUST = 0.9
_SMOOTH = 1.0
_BEFORE, _AFTER = 40, 20
_STEP = 64


# --- spans of a pattern ----------------------------------------------------------------------------


def signs(text: Column, digit: Column) -> dict[str, Column]:
    """Per scan, false for texts that surely hold no match; plain searches, much cheaper than the patterns."""
    stems = [t for t in TITLES if not any(t != u and t.startswith(u) for u in TITLES)]
    titled = functools.reduce(or_, [text.contains(t) for t in stems]) & text.rlike(rf"{_TITLE}\.? \p{{Lu}}")
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(rf"(?i)(?:{_SECRET})[\"']?\s{{0,3}}[=:]")
    six = text.contains(":") & text.rlike("(?:[A-Fa-f]{1,4}:){7}")
    loose = digit | text.contains("[at") | text.contains("(at") | assigned | titled | six
    return {"email": text.contains("@"), "ip": digit, "card": digit, "phone": digit & text.contains("+"), "loose": loose}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut(text: Column, pattern: str, sign: Column) -> Column:
    """Matches ``m`` of a text and the texts ``p`` around them, one more."""
    found = F.when(sign, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))

    def around(m: Column) -> Column:
        return F.struct(m.alias("m"), F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array(text)).alias("p"))

    return _let(found, around)


def scan(text: Column, pattern: str, sign: Column) -> Column:
    """Matches as ``(at, m, before, after)``.

    Positions are running totals of the lengths, taken in steps of 64 matches, so texts of many matches stay cheap.
    """
    zero = F.lit(0).cast("long")

    def total(lengths: Column, start: Column, count: Column) -> Column:
        return F.aggregate(F.slice(lengths, start + 1, count), zero, lambda a, x: a + x)

    def bases(lengths: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.size(lengths) / _STEP).cast("int"))
        sums = F.aggregate(steps, F.array(zero), lambda a, b: F.array_append(a, F.element_at(a, -1) + total(lengths, b * _STEP, F.lit(_STEP))))
        return F.struct(lengths.alias("l"), sums.alias("b"))

    def span(cut: Column, sums: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / _STEP).cast("int")
        before = F.get(cut["p"], i)
        at = F.get(sums["b"], block) + total(sums["l"], block * _STEP, i % _STEP) + F.length(before)
        after = F.substring(F.get(cut["p"], i + 1), 1, _AFTER)
        return F.struct(at.alias("at"), m.alias("m"), F.right(before, F.lit(_BEFORE)).alias("before"), after.alias("after"))

    def placed(cut: Column) -> Column:
        lengths = F.transform(cut["m"], lambda m, i: (F.length(m) + F.length(F.get(cut["p"], i))).cast("long"))
        return _let(_let(lengths, bases), lambda sums: F.transform(cut["m"], lambda m, i: span(cut, sums, m, i)))

    return _let(_cut(text, pattern, sign), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a match of a base format is a base span."""
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _masked(text: Column, kind: str) -> Column:
    """Text with the base spans of a kind replaced by as many mask characters."""

    def hidden(p: Column, m: Column) -> Column:
        return F.concat(p, F.when(m.isNull(), "").when(passes(kind, m), F.repeat(F.lit(_MASK), F.length(m))).otherwise(m))

    return _let(_cut(text, BASE[kind], F.lit(True)), lambda cut: F.array_join(F.zip_with(cut["p"], cut["m"], hidden), ""))


def _kind_of(m: Column) -> Column:
    return (
        F.when(m.rlike(rf"\A(?i:{_SECRET})[^A-Za-z]"), "secret")
        .when(m.rlike(rf"\A{_TITLE}\.? "), "name")
        .when(m.rlike(r"[\[(]at[\])]"), "email")
        .when(m.rlike(r":|\A[0-9]+(?:\.[0-9]+){3}\z"), "ip")
        .when(m.rlike(r"\A[A-Z]{2}[0-9]{2}|\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "id")
        .when(F.length(_digits(m)) >= 13, "card")
        .otherwise("phone")
    )


def _candidate(kind: Column | str, base: bool, c: Column) -> Column:
    """Span with its value apart from the words that lead to it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    value = (
        F.when(kind == "secret", F.regexp_replace(c["m"], _SECRET_LEAD, ""))
        .when(kind == "name", F.regexp_replace(c["m"], r"\A\S+ ", ""))
        .otherwise(c["m"])
    )
    lead = F.substring(c["m"], F.lit(1), F.length(c["m"]) - F.length(value))
    return F.struct(
        kind.alias("kind"),
        F.lit(base).alias("base"),
        (c["at"] + F.length(lead)).alias("at"),
        (c["at"] + F.length(c["m"])).alias("end"),
        value.alias("m"),
        F.concat(c["before"], lead).alias("before"),
        c["after"].alias("after"),
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(row, base, more)``: the row as a struct, base spans by kind and start, and further candidates by start."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("left", F.col("text"))
    sign = signs(F.col("text"), F.col("digit"))
    for kind in BASE_KINDS:
        spans = scan(F.col("text"), BASE[kind], sign[kind])
        df = df.withColumn(kind, F.filter(spans, lambda c: passes(kind, c["m"])))  # noqa: B023
        df = df.withColumn("left", F.when(F.size(kind) > 0, _masked(F.col("left"), kind)).otherwise(F.col("left")))
    df = df.withColumn("loose", scan(F.col("left"), LOOSE, sign["loose"]))
    base = F.concat(*[F.transform(k, lambda c: _candidate(k, True, c)) for k in BASE_KINDS])  # noqa: B023
    more = F.transform("loose", lambda c: _candidate(_kind_of(c["m"]), False, c))
    return df.select("row", base.alias("base"), more.alias("more"))


# --- labelers and features ---------------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(kind: Column, m: Column, before: Column, after: Column, base: Column) -> list[Column]:
    """Votes of the labelers on a span, in the order of LABELERS."""
    digits, n = _digits(m), F.length(m)
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (n >= 16)
    strict = (
        F.when(kind == "secret", F.when(mixed, 1).when(n < 12, -1).otherwise(0))
        .when(kind == "name", F.when(m.contains(" "), 1).otherwise(0))
        .when(kind == "id", 1)
        .when(kind == "phone", F.when(F.length(digits).between(9, 15), F.when(base, 1).otherwise(0)).otherwise(-1))
        .when(kind == "ip", F.when(base | m.contains(":"), 1).otherwise(-1))
        .when(kind == "card", F.when(base, 1).otherwise(-1))
        .otherwise(F.when(base, 1).otherwise(0))
    )
    kinds_of = F.size(F.array_distinct(F.split(F.substring(m, 1, 64), "")))
    variety = _vote(kinds_of >= 5, (kinds_of <= 3) | m.rlike(r"(?i)0123456|1234567|abcdef"))
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)\z", 1))
    code = F.regexp_extract(m, r"\A\+([0-9]{1,2})", 1)
    known = (
        F.when(kind == "email", _vote(ending.isin(ENDINGS), ending.isin(FILE_ENDINGS) | ending.rlike(r"\A[0-9]*\z")))
        .when(kind == "ip", _vote(~m.rlike(r"\A(?:0|10|127|255|192\.168|172\.16)\."), m.rlike(r"\A(?:0|10|127|255|192\.168|172\.16)\.")))
        .when(kind == "card", _vote(digits.rlike(r"\A[3-6]"), ~digits.rlike(r"\A[3-6]")))
        .when(kind == "phone", F.when(code.isin(CALLING_CODES) | F.substring(code, 1, 1).isin(CALLING_CODES), 1).otherwise(0))
        .when(kind == "id", F.when(F.substring(m, 1, 2).isin(ACCOUNT_LANDS), 1).otherwise(0))
        .when(kind == "name", F.when(F.regexp_extract(m, r"\A([\p{L}'-]+)", 1).isin(GIVEN_NAMES), 1).otherwise(0))
        .otherwise(F.when(m.rlike(f"(?i)(?:{PLACEHOLDERS})"), -1).otherwise(0))
    )
    cued = F.lit(False)
    for k in KINDS:
        cued = F.when(kind == k, before.rlike(CUES[k] if k == "name" else f"(?i)(?:{CUES[k]})")).otherwise(cued)
    said = _vote(cued, before.rlike(f"(?i)(?:{ANTI_CUES})"))
    stuck = before.rlike(r"[\p{L}0-9_]\z") | after.rlike(r"\A[\p{L}0-9_]")
    return [strict, variety, known, said, _vote(~stuck, stuck)]


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit")
        .when(c.rlike(r"[\"'`(\[{<>})\]]"), "bracket").when(c.rlike("[.,;:!?]"), "stop").otherwise("other")
    )


def features(kind: Column, m: Column, before: Column, after: Column) -> Column:
    """Shape and surroundings as ``kind|name:value``; each name has at most eleven values."""
    n = F.length(m)

    def tenths(pattern: str) -> Column:
        return F.floor(10 * F.length(F.regexp_replace(m, pattern, "")) / F.greatest(n, F.lit(1)))

    cued = F.lit(False)
    for k in KINDS:
        cued = F.when(kind == k, before.rlike(f"(?i)(?:{CUES[k]})")).otherwise(cued)
    parts = {
        "length": F.least(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(8).cast("long")),
        "digits": tenths("[^0-9]"),
        "letters": tenths(r"[^\p{L}]"),
        "upper": F.least(tenths(r"[^\p{Lu}]"), F.lit(5).cast("long")),
        "marks": F.least(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.lit(6)),
        "groups": F.least(F.size(F.split(m, r"[^\p{L}0-9]+")), F.lit(8)),
        "first": _char_class(F.substring(m, 1, 1)),
        "before": _char_class(F.right(before, F.lit(1))),
        "after": _char_class(F.substring(after, 1, 1)),
        "cue": cued,
        "against": before.rlike(f"(?i)(?:{ANTI_CUES})"),
    }
    return F.array(*[F.concat(kind, F.lit(f"|{name}:"), c.cast("string")) for name, c in parts.items()])


# --- reliabilities and classifier ----------------------------------------------------------------------


def first_guess(cast: tuple[int, ...]) -> float:
    """Probability of a true span from its votes alone."""
    return 1 / (1 + math.exp(-sum(v if v > 0 else 2 * v for v in cast)))


def estimate(counts: dict[tuple, int], rounds: int = 500, least: float = 1e-10) -> tuple[dict[tuple, float], dict[str, list[dict]], dict[str, float]]:
    """Expectation-maximisation over counted ``(kind, votes ...)``.

    Returns the probability of a true span per combination, per labeler the chance of each vote under (false, true), and the
    share of true spans per kind.  Starts from the votes, a no being rarer and so twice a yes; ends when no probability moves.
    """
    p = {k: first_guess(k[1:]) for k in counts}
    worth: dict[str, list[dict]] = {}
    prior: dict[str, float] = {}
    for _ in range(rounds):
        for j, name in enumerate(LABELERS):
            seen = [{v: _SMOOTH for v in (-1, 0, 1)} for _ in range(2)]
            for k, n in counts.items():
                seen[1][k[1 + j]] += n * p[k]
                seen[0][k[1 + j]] += n * (1 - p[k])
            worth[name] = [{v: c / sum(s.values()) for v, c in s.items()} for s in seen]
        for kind in {k[0] for k in counts}:
            mine = [(n, p[k]) for k, n in counts.items() if k[0] == kind]
            prior[kind] = (sum(n * q for n, q in mine) + _SMOOTH) / (sum(n for n, _ in mine) + 2 * _SMOOTH)
        moved = 0.0
        for k in counts:
            odds = math.log(prior[k[0]] / (1 - prior[k[0]]))
            odds += sum(math.log(worth[name][1][v] / worth[name][0][v]) for name, v in zip(LABELERS, k[1:]))
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            moved = max(moved, abs(q - p[k]))
            p[k] = q
        if moved < least:
            break
    return p, worth, prior


class SpanClassifier:
    """Log odds per feature and per kind, learnt from soft labels."""

    def __init__(self, weights: dict[str, float], prior: dict[str, float], worth: dict[str, list[dict]]):
        self.weights, self.prior, self.worth = weights, prior, worth

    def trusts(self, c: Column) -> Column:
        """Whether a candidate is a span; kinds never seen are not."""
        if not self.weights:
            return F.lit(False)
        table = F.create_map(*[F.lit(x) for pair in self.weights.items() for x in pair])
        start = F.lit(-math.inf)
        for kind, odds in self.prior.items():
            start = F.when(c["kind"] == kind, odds).otherwise(start)
        named = features(c["kind"], c["m"], c["before"], c["after"])
        score = F.aggregate(named, start, lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return score >= math.log(TRUST / (1 - TRUST))


def train(found: DataFrame) -> SpanClassifier:
    """Votes on all spans, their worth, and the classifier trained on the result."""
    spark: SparkSession = found.sparkSession
    each = found.select(F.explode(F.concat("base", "more")).alias("c")).select("c.*")
    voted = dict(zip(LABELERS, votes(*[F.col(c) for c in ("kind", "m", "before", "after", "base")])))
    named = features(*[F.col(c) for c in ("kind", "m", "before", "after")])
    judged = cut_lineage(each.select("kind", *[v.alias(n) for n, v in voted.items()], named.alias("features")))
    counted = judged.groupBy("kind", *LABELERS).count().collect()  # at most 3 ** 5 rows a kind
    counts = {tuple(r)[:-1]: r["count"] for r in counted}
    p, worth, prior = estimate(counts)
    if not counts:
        return SpanClassifier({}, {}, worth)
    soft = spark.createDataFrame([(*k, q) for k, q in p.items()], "kind string, " + ", ".join(f"{n} int" for n in LABELERS) + ", p double")
    rows = judged.join(F.broadcast(soft), ["kind", *LABELERS])
    sums = rows.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    sums = sums.collect()  # some hundred rows: names times values times kinds
    totals: dict[str, list[float]] = {}
    values: dict[str, int] = {}
    for r in sums:
        name = r["f"].split(":")[0]
        have = totals.setdefault(name, [0.0, 0.0])
        have[0], have[1] = have[0] + r["yes"], have[1] + r["no"]
        values[name] = values.get(name, 0) + 1
    weights = {}
    for r in sums:
        name = r["f"].split(":")[0]
        (yes, no), k = totals[name], values[name]
        weights[r["f"]] = math.log((r["yes"] + _SMOOTH) / (yes + k * _SMOOTH)) - math.log((r["no"] + _SMOOTH) / (no + k * _SMOOTH))
    return SpanClassifier(weights, {k: math.log(q / (1 - q)) for k, q in prior.items()}, worth)


def personal_data(docs: DataFrame, text: str = "text", classifier: SpanClassifier | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_<kind>`` of the base spans, ``base_spans`` and ``spans``.

    Spans are ``(kind, start, end)`` structs by the order of KINDS, then start.  The classifier is trained on ``docs`` unless given.
    """
    if classifier is None:
        classifier = train(find(docs, text))
    found = find(docs, text)
    rank = {k: F.lit(i) for i, k in enumerate(KINDS)}

    def placed(c: Column) -> Column:
        order = F.lit(len(KINDS))
        for k, i in rank.items():
            order = F.when(c["kind"] == k, i).otherwise(order)
        return F.struct(order.alias("rank"), c["at"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    added = F.filter("more", classifier.trusts)
    every = F.array_sort(F.transform(F.concat(F.col("base"), added), placed))
    new = {f"n_{k}": F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long") for k in BASE_KINDS}  # noqa: B023
    new["base_spans"] = plain(F.transform("base", placed))
    new["spans"] = plain(every)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return found.select(*kept, *[c.alias(n) for n, c in new.items()])


def written(spans: Column | str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    parts = F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")))
    return F.array_join(parts, ",")
