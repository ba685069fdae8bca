"""The whole workflow over a folder of tables, step by step, skipping what is already there.

Expected inputs under ``root``:

* ``applications``               CSV with header: label, month, age, categories, numeric features
* ``decisions``                  parquet (scen, cost, seed, case_id, assignment, batch, decision): training logs
* ``predictions``                parquet (scen, cost, case_id, expert, p): experts 0/1, classifier a probability
* ``testbed/<scen>-l_<cost>/<env>/batches.csv`` and ``capacity.csv``

Written: ``cases``, ``scored``, ``alerts``, ``models``, ``trials``, ``model_properties``, ``probabilities``, and run by run
``assignments`` and ``results``, each with a manifest of its finished runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import alerts, evaluation, joins, learning, metrics, policies, reshape
from caseloom.session import cut_lineage
from caseloom.sources import ledger, registry, tables, testbed

GRID = ["scen", "cost"]
#: Keys of a run, the unit that is done once.
RUN = [*GRID, "seed", "method", "env"]
#: Which policy uses the probabilities of which correctness model.
RULES = {"joint": "optimal", "one_vs_all": "greedy"}


@dataclass
class Settings:
    """What a run may vary; the defaults are the configured grid."""

    root: str
    humans: Sequence[str] | None = None  # the team of every scenario; None takes each scenario's own from its logs
    numeric: Sequence[str] | None = None  # numeric features; None takes every column of the applications without a role
    domains: dict[str, Sequence[str]] = field(default_factory=lambda: config.DOMAINS)
    costs: Sequence[float] = tuple(config.COSTS)
    alert_space: dict = field(default_factory=lambda: config.ALERT_SPACE)
    classifier_spaces: Sequence[dict] = tuple(config.CLASSIFIER_SPACES)
    expert_space: dict = field(default_factory=lambda: config.EXPERT_SPACE)
    trials: int | None = None
    offsets: int = config.OFFSET_STEPS
    seed: int = config.SAMPLE_SEED

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def n_trials(self, space: dict) -> int:
        return self.trials or space["trials"]

    @property
    def features(self) -> list[str]:
        if self.numeric is None:
            raise ValueError("numeric features are not known yet; see complete()")
        return [*self.numeric, config.PROTECTED]


def complete(spark: SparkSession, s: Settings) -> Settings:
    """Settings with the numeric features named; all that pass through unless some were chosen."""
    return s if s.numeric is not None else replace(s, numeric=tables.numeric_features(spark, s.path("applications")))


def load_applications(spark: SparkSession, s: Settings) -> DataFrame:
    """Applications with their case id, the place in the order (month, line), assigned and written once."""
    if not tables.exists(spark, s.path("cases")):
        rows = tables.read_csv(spark, s.path("applications"), tables.applications_schema(s.numeric), line="_line")
        tables.write(tables.with_case_id(rows, "_line").drop("_line"), s.path("cases"))
    return spark.read.parquet(s.path("cases"))


def score_applications(spark: SparkSession, s: Settings) -> None:
    """Search and fit the alert scorer, store model, properties and the scored deployment months."""
    if tables.exists(spark, s.path("scored")):
        return
    rows = load_applications(spark, s)
    ready = learning.with_features(rows, s.domains, s.features)
    measure = learning.TprAtFpr()
    trials, _ = learning.search(
        ready.filter(scalars.in_span(config.TIMESTAMP, *config.MODEL_SPANS["train"])),
        ready.filter(scalars.in_span(config.TIMESTAMP, *config.MODEL_SPANS["validation"])),
        learning.draw_params(s.alert_space, s.n_trials(s.alert_space), s.seed),
        lambda df, p: learning.boosted_trees(p, config.LABEL).fit(df),
        lambda scored: -measure.evaluate(learning.positive_probability(scored)),
        log=registry.TrialLog(spark, s.path("trials/alert"), {"study": "alert"}),
    )
    best = trials.orderBy("loss", "trial").first().asDict()
    model = learning.fit_alert_scorer(rows, best, s.domains, s.features)
    registry.save_model(model, s.path("models/alert"))
    tables.write(learning.score_deployment(rows, model), s.path("scored"))
    _alert_properties(spark, s)


def _alert_properties(spark: SparkSession, s: Settings) -> None:
    """Threshold at the target rate on the validation month and its quality on the deployment months."""
    scored = spark.read.parquet(s.path("scored"))
    month = scalars.in_span(config.TIMESTAMP, *config.MODEL_SPANS["validation"])
    limit = alerts.threshold_at_fpr(scored.filter(month), [], config.LABEL, "model_score", [config.DATA_RATE]).first()
    marked = scored.withColumn("_d", scalars.binarize("model_score", limit["threshold"]))
    rates = metrics.with_rates(metrics.confusion(marked, [], config.LABEL, "_d")).select(F.lit("alert").alias("model"), "fnr")
    gap = metrics.fpr_by_age(marked, [], config.LABEL, "_d", config.PROTECTED).select(
        F.lit("alert").alias("model"), F.col("fpr_difference").alias("disparity")
    )
    out = rates.join(gap, "model").withColumns({"threshold": F.lit(limit["threshold"]), "fpr": F.lit(config.DATA_RATE)})
    registry.write_properties(
        registry.properties_long(out, ["model"], ["fpr", "fnr", "threshold", "disparity"]), s.path("model_properties/alert")
    )


def make_alerts(spark: SparkSession, s: Settings) -> None:
    """Alert tables of all scenarios, one folder each."""
    if not tables.exists(spark, s.path("alerts")):
        found = alerts.alert_scenarios(spark.read.parquet(s.path("scored")), seed=s.seed)
        tables.write(found, s.path("alerts"), partition_by=["scen"])


def scenario_grid(spark: SparkSession, s: Settings) -> DataFrame:
    """(scen, cost) pairs of the alert tables present."""
    found = spark.read.parquet(s.path("alerts")).select("scen").distinct()
    named = found.withColumn("sub", scalars.scenario_fields("scen")["sub"])
    return joins.expand_grid(named, s.costs, config.SUBSAMPLE_COSTS).select(*GRID)


def train_classifiers(spark: SparkSession, s: Settings) -> None:
    """The cost-weighted classifier of every pending (scenario, cost) and its report."""
    todo = tables.pending(scenario_grid(spark, s), s.path("model_properties/classifier"), GRID)
    for scen, cost in sorted(tuple(r) for r in todo.collect()):
        rows = spark.read.parquet(s.path("alerts")).filter(F.col("scen") == scen)
        ready = learning.with_features(rows, s.domains, s.features)
        counts = [s.n_trials(space) for space in s.classifier_spaces]
        log = registry.TrialLog(spark, s.path("trials/classifier"), {"scen": scen, "cost": cost})
        _, model = learning.sweep_classifier(ready, cost, s.classifier_spaces, counts, s.offsets, s.seed, log=log)
        model.save(s.path(f"models/classifier/{scen}-l_{cost}"), spark)
        scored = model.transform(ready).withColumn("cost", F.lit(cost))
        report = learning.classifier_report(scored, ["scen"], "cost")
        values = ["fpr", "fnr", "prev", "model_cost", "reject_all_cost"]
        registry.write_properties(
            registry.properties_long(report, ["scen", "cost", "split"], values), s.path("model_properties/classifier"), GRID
        )


def train_expert_models(spark: SparkSession, s: Settings, methods: Sequence[str] = ("joint", "one_vs_all")) -> None:
    """Probabilities that each expert decides each test case rightly, for every pending run."""
    grid = spark.read.parquet(s.path("decisions")).select(*GRID, "seed").distinct()
    named = grid.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    todo = tables.pending(named.select(*tables.STORE_KEYS), s.path("probabilities"), tables.STORE_KEYS)
    team = rosters(spark, s)
    for scen, cost, method, seed in sorted(tuple(r) for r in todo.collect()):
        cases = spark.read.parquet(s.path("alerts")).filter(F.col("scen") == scen).drop("scen")
        here = (F.col("scen") == scen) & (F.col("cost") == cost)
        decided = spark.read.parquet(s.path("decisions")).filter(here & (F.col("seed") == seed)).drop(*GRID, "seed")
        log = learning.decision_log(decided.join(cases, "case_id"), cost)
        test = cases.filter(scalars.in_span(config.TIMESTAMP, *config.ALERT_SPANS["test"]))
        humans = team[scen, cost]
        params = _best_expert_params(s, log, method, humans)
        if method == "joint":
            model = learning.fit_joint(log, params, humans, s.domains, s.features)
            pairs = learning.score_joint(test, model, humans)
        else:
            models = learning.fit_one_vs_all(log, params, humans, s.domains, s.features)
            pairs = learning.score_one_vs_all(test, models, s.domains, s.features)
        own = spark.read.parquet(s.path("predictions")).filter(here & (F.col("expert") == joins.MODEL))
        pairs = learning.with_classifier(pairs, own.join(test.select("case_id"), "case_id"))
        run = {"scen": F.lit(scen), "cost": F.lit(cost), "method": F.lit(method), "seed": F.lit(seed)}
        tables.write_probabilities(pairs.withColumns(run), s.path("probabilities"))


def rosters(spark: SparkSession, s: Settings) -> dict[tuple[str, float], list[str]]:
    """The team of every (scenario, cost): a few names for each scenario of the grid."""
    found = joins.rosters(spark.read.parquet(s.path("decisions")), GRID, "assignment").collect()
    return {(r["scen"], r["cost"]): list(r["roster"] if s.humans is None else s.humans) for r in found}


def _best_expert_params(s: Settings, log: DataFrame, method: str, humans: Sequence[str]) -> dict | dict[str, dict]:
    """Settings with the lowest weighted log loss on the validation month.

    The joint model has one search; one-vs-all has one per expert.
    """
    a, b = config.ALERT_SPANS["validation"]

    def best(rows: DataFrame, domains) -> dict:
        ready = learning.with_features(rows, domains, s.features)
        validation = scalars.in_span(config.TIMESTAMP, a, b)
        trials, _ = learning.search(
            ready.filter(~validation),
            ready.filter(validation),
            learning.draw_params(s.expert_space, s.n_trials(s.expert_space), s.seed),
            lambda df, p: learning.boosted_trees(p, learning.CORRECT, weight=learning.WEIGHT).fit(df),
            lambda out: learning.weighted_loss(learning.CORRECT)(learning.positive_probability(out)),
        )
        return trials.orderBy("loss", "trial").first().asDict()

    if method == "joint":
        return best(log, {**s.domains, "assignment": list(humans)})
    return {e: best(log.filter(F.col("assignment") == e), s.domains) for e in humans}


def _ledger(spark: SparkSession, s: Settings, name: str) -> ledger.RunLedger:
    return ledger.RunLedger(spark, s.path(name), RUN)


def run_deferral(spark: SparkSession, s: Settings) -> None:
    """Assignments of every policy, scenario, cost, seed and environment not done yet, in one job."""
    pattern = s.path("testbed/*/*/")
    batches = cut_lineage(_split_grid(testbed.read_batches(spark, pattern + "batches.csv", grid=True)))
    caps = cut_lineage(_split_grid(testbed.read_capacity(spark, pattern + "capacity.csv", s.humans, grid=True)))
    keys = [*GRID, "env"]
    stored = tables.read_probabilities(spark, s.path("probabilities"))
    beds = batches.select(*keys).distinct()
    rule_of = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    trained = stored.select(*GRID, "seed", "method").distinct().withColumn("method", rule_of[F.col("method")])
    plain = beds.withColumns({"seed": F.lit(policies.NO_SEED), "method": F.explode(F.array(*[F.lit(m) for m in policies.UNSEEDED]))})
    book = _ledger(spark, s, "assignments")
    todo = cut_lineage(book.pending(beds.join(trained, GRID).select(*RUN).union(plain.select(*RUN))))
    if todo.isEmpty():
        return
    parts = []
    for method, rule in RULES.items():
        mine = todo.filter(F.col("method") == rule).select(*keys, "seed")
        if mine.isEmpty():
            continue
        p = stored.filter(F.col("method") == method).drop("method")
        here = batches.join(mine.select(*keys).distinct(), keys, "left_semi")
        joins.require_keys(here.select(*GRID, "case_id"), p, [*GRID, "case_id"])
        pred = here.join(p, [*GRID, "case_id"]).join(mine, [*keys, "seed"], "left_semi")
        parts.append(policies.run_policies(here, pred, caps, keys, joins.MODEL, [rule]))
    mine = todo.filter(F.col("method").isin(policies.UNSEEDED))
    here = batches.join(mine.select(*keys).distinct(), keys, "left_semi")
    unseeded = policies.run_policies(here, stored, caps, keys, joins.MODEL, policies.UNSEEDED, s.seed)
    parts.append(unseeded.join(mine.select(*keys, "method"), [*keys, "method"], "left_semi").select(unseeded.columns))
    assigned = reshape.union_all(parts)
    decided = spark.read.parquet(s.path("predictions")).withColumn("decision", scalars.binarize("p", 0.5))
    book.commit(policies.with_predictions(assigned, decided, GRID), todo)


def _split_grid(df: DataFrame) -> DataFrame:
    """(scen, cost) from the folder name ``<scen>-l_<cost>``."""
    name = F.col("grid")
    return df.withColumns(
        {"scen": F.regexp_extract(name, "^(.*)-l_[0-9.]+$", 1), "cost": F.regexp_extract(name, "-l_([0-9.]+)$", 1).cast("double")}
    ).drop("grid")


def report(spark: SparkSession, s: Settings) -> DataFrame:
    """The evaluation table of all finished runs; a run is evaluated once."""
    book = _ledger(spark, s, "results")
    decisions = _ledger(spark, s, "assignments").read().withColumn("seed", F.col("seed").cast("string"))
    todo = cut_lineage(book.pending(decisions.select(*RUN)))
    if not todo.isEmpty():
        labels = spark.read.parquet(s.path("alerts")).filter(F.col(config.TIMESTAMP) == 7)
        labels = labels.groupBy("case_id").agg(*[F.max(c).alias(c) for c in (config.LABEL, config.PROTECTED)])
        found = evaluation.evaluate_runs(decisions.join(todo, RUN, "left_semi"), labels)
        book.commit(found.withColumn("seed", F.coalesce("seed", F.lit(policies.NO_SEED))), todo)
    out = book.read()
    return out.withColumn("seed", scalars.na_to_null(F.col("seed").cast("string")))


STEPS = {
    "score": score_applications,
    "alerts": make_alerts,
    "classifier": train_classifiers,
    "experts": train_expert_models,
    "deferral": run_deferral,
    "report": report,
}


def run(spark: SparkSession, settings: Settings, steps: Sequence[str] = tuple(STEPS)) -> None:
    settings = complete(spark, settings)
    for name in steps:
        STEPS[name](spark, settings)
