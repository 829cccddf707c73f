"""Retraining cycles: triggers, candidates fit on late labels, gating, versions in force.

Triggers depend on the drift signal and on label arrivals, not on the model in force, so all
cycles of all devices are laid out as tables: one row per attempt, its candidate fit by one
grouped aggregation (naive Bayes statistics add up), its validation score by another. Only
the comparison with the model then in force is sequential, over the few attempts of a device.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import feedback, metrics, models
from tidegauge.operators.ordering import Axis
from tidegauge.plans import events as E
from tidegauge.session import materialise, passing

FEATURES = ("z_value", "z_k")
DELAY, NEWEST = E.LABEL_DELAY, 100
#: Rows of a series that are looked up together when candidates gather the labels they learn from.
SPAN = 128
#: Candidates and validation rows that a task judges at once, and candidates whose answers it holds at a time.
JUDGED_ATTEMPTS, JUDGED_ROWS, HELD = 4096, 1 << 14, 32
#: Pairs of a block of candidates and a block of rows that a task judges on average.
JUDGED_PAIRS = 4
MIN_METRIC, MARGIN = 0.40, 0.05


def fired(rows: DataFrame, axis: Axis) -> DataFrame:
    """Attempts (series, attempt, trigger_idx): persistent high severity, enough labels, cooldown over.

    `rows` hold raw_severity and smoothed_severity; a label is known DELAY rows after its observation.
    """
    d = rows.select(*axis.series, axis.idx, "raw_severity", "smoothed_severity")
    d = axis.bounded(d, {"alarms": lambda w: F.sum((F.col("raw_severity") > 0.55).cast("long")).over(w.rowsBetween(-19, 0))}, back=19)
    ready = d.withColumn("is_persistent", F.col("alarms") >= 4).withColumn(
        "n_eligible", F.greatest(F.col(axis.idx) - DELAY + 1, F.lit(0))
    )
    out = feedback.adaptation_triggers(materialise(ready, "ready"), axis, min_severity=0.35, min_feedback=25, cooldown=50)
    numbered = axis.running(materialise(out.select(*axis.series, axis.idx, "fired"), "fired"), sums={"__k": F.col("fired").cast("long")})
    return materialise(
        numbered.where("fired").select(*axis.series, (F.col("__k") - 1).alias("attempt"), F.col(axis.idx).alias("trigger_idx")),
        "attempts",
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per device."""

    def build() -> DataFrame:
        with passing(spark, "attempts"):
            return fired(E.reliable(spark, sf_dir), E.STREAM)

    return E.staged(spark, sf_dir, "attempts", build)


def baseline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first model: class statistics of the whole training role."""
    return models.nb_fit(models.causal_fit_data(E.normalised(spark, sf_dir), FEATURES, "y"), FEATURES, "y")


def candidates(attempts: DataFrame, rows: DataFrame, base: DataFrame, axis: Axis) -> DataFrame:
    """Class statistics per attempt: the newest labels of its series plus its device's own baseline rows.

    Each attempt names the spans of SPAN rows that its NEWEST rows lie in, one or two, and meets the rows there; the baseline
    enters as two rows of statistics per device. Attempts grow with the stream, but look small to the planner, as their files
    hold little more than numbers in a row; joins with them are told to merge, or they would be gathered on the driver.
    """
    keys = [*axis.series, "attempt"]
    newest = F.col("trigger_idx") - DELAY
    ends = attempts.select(*keys, F.greatest(newest - NEWEST + 1, F.lit(0)).alias("__from"), newest.alias("__to"))
    span = lambda c: F.floor(c / F.lit(SPAN)).cast("long")
    wanted = ends.withColumn("__span", F.explode(F.sequence(span(F.col("__from")), span(F.col("__to")))))
    known = rows.select(*axis.series, span(F.col(axis.idx)).alias("__span"), axis.idx, *FEATURES, "y")
    late = wanted.hint("merge").join(known, [*axis.series, "__span"]).where(F.col(axis.idx).between(F.col("__from"), F.col("__to")))
    late = late.select(*keys, *FEATURES, "y")
    fit = lambda d, by: d.groupBy(*by, F.col("y").alias("label")).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"{c}__sum") for c in FEATURES],
        *[F.sum(F.col(c) * F.col(c)).alias(f"{c}__sq") for c in FEATURES],
    )
    own = attempts.select(*keys).hint("merge").join(fit(base.select("series_id", *FEATURES, "y"), ["series_id"]), "series_id")
    both = fit(late, keys).unionByName(own)
    return both.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in both.columns if c not in (*keys, "label")])


def wide_models(stats: DataFrame, axis: Axis) -> DataFrame:
    """One row per attempt with both classes' statistics side by side."""
    keys = [*axis.series, "attempt"]
    values = [c for c in stats.columns if c not in (*keys, "label")]
    return stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("label") == k, F.col(v))).alias(f"{v}__{k}") for v in values for k in (0, 1)]
    )


#: A candidate's statistics on its row, as `wide_models` names them.
MODEL = [f"{c}__{k}" for c in ("n", *[f"{f}__{s}" for f in FEATURES for s in ("sum", "sq")]) for k in (0, 1)]


def posterior() -> Column:
    """p1 of a row that carries its model's statistics."""
    return models.nb_posterior(FEATURES, lambda name, k: F.col(f"{name}__{k}"))


def judged(wide: DataFrame, val: DataFrame, axis: Axis) -> DataFrame:
    """tp, fp, fn, tn of every candidate on the validation rows of its device; a row without features, label or model counts nowhere.

    Every pair of a candidate and a row is judged, so the work is laid out in pairs of blocks of both, as many in a device as it
    takes, and dealt by pairs: a pair costs the same whatever it holds in bytes, which is what adaptive execution would join
    tasks by. A log posterior ratio is a sum of five products, so a block of candidates meets a block of rows in a matrix product;
    what lies within rounding of one half is taken from the posterior itself, as `models.nb_posterior` has it.
    """
    keys, series = [*axis.series, "attempt"], list(axis.series)
    complete = lambda names: F.expr(" AND ".join(f"{c} IS NOT NULL" for c in names))
    model = F.struct("attempt", complete(MODEL).alias("usable"), *[F.coalesce(F.col(c).cast("double"), F.lit(1.0)).alias(c) for c in MODEL])
    row = F.when(complete([*FEATURES, "y"]), F.struct(*[F.col(c).cast("double").alias(c) for c in FEATURES], "y"))
    block = lambda c, n: F.floor(F.col(c) / F.lit(n)).cast("long")
    some = wide.groupBy(*series, block("attempt", JUDGED_ATTEMPTS).alias("__some")).agg(F.collect_list(model).alias("__m"))
    part = val.groupBy("series_id", block("row_idx", JUDGED_ROWS).alias("__part")).agg(F.collect_list(row).alias("__v"))
    part = materialise(part.select("series_id", "__part", *[F.col(f"__v.{c}").alias(f"v_{c}") for c in (*FEATURES, "y")]), "judges")
    some = materialise(some.select(*series, "__some", *[F.col(f"__m.{c}").alias(f"m_{c}") for c in ("attempt", "usable", *MODEL)]), "judged")
    pairs = materialise(some.select(*series, "__some").join(part.select("series_id", "__part"), "series_id"), "pairs")
    # A number, and none below the session's: a join deals such sides anew, and adaptive execution would join its tasks.
    tasks = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // JUDGED_PAIRS))
    pair = [*series, "__some", "__part"]
    sides = [
        pairs.hint("merge").join(some, [*series, "__some"]).repartition(tasks, *pair),
        pairs.hint("merge").join(part, ["series_id", "__part"]).repartition(tasks, *pair),
    ]
    pairs = sides[0].hint("merge").join(sides[1], pair)
    schema = ", ".join([*[f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in keys], *[f"{c} long" for c in COUNTS]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pair in pdf.to_dict("records"):
                out = pd.DataFrame({c: [pair[c]] * len(pair["m_attempt"]) for c in series})
                out["attempt"] = pair["m_attempt"]
                counts = confusion({c: np.asarray(pair[f"m_{c}"], dtype=float) for c in MODEL}, [np.asarray(pair[f"v_{c}"], dtype=float) for c in FEATURES], np.asarray(pair["v_y"]))
                usable = np.asarray(pair["m_usable"], dtype=bool)
                for c, n in zip(COUNTS, counts):
                    out[c] = np.where(usable, n, 0)
                yield out

    told = pairs.mapInPandas(run, schema)
    return told.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ("tp", "fp", "fn", "tn")


def log_ratio(model: dict[str, np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    """log p0 - log p1 (one candidate or row per position), in the order of `models.nb_posterior`."""
    joint = []
    for k in (0, 1):
        n = model[f"n__{k}"]
        total = np.log(n / (model["n__0"] + model["n__1"]))
        for c, x in zip(FEATURES, features):
            mean = model[f"{c}__sum__{k}"] / n
            var = np.maximum(model[f"{c}__sq__{k}"] / n - mean * mean, 1e-9)
            gap = x - mean
            total = total + -0.5 * (np.log(2.0 * np.pi * var) + gap * gap / var)
        joint.append(total)
    return joint[0] - joint[1]


def confusion(model: dict[str, np.ndarray], features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """tp, fp, fn, tn per candidate: candidates x rows in a matrix product, HELD candidates at a time."""
    with np.errstate(all="ignore"):
        constant, terms = np.log(model["n__0"]) - np.log(model["n__1"]), []
        for c in FEATURES:
            square, linear = 0.0, 0.0
            for k, sign in ((0, -0.5), (1, 0.5)):
                mean = model[f"{c}__sum__{k}"] / model[f"n__{k}"]
                var = np.maximum(model[f"{c}__sq__{k}"] / model[f"n__{k}"] - mean * mean, 1e-9)
                square, linear = square + sign / var, linear - 2.0 * sign * mean / var
                constant = constant + sign * (np.log(var) + mean * mean / var)
            terms += [square, linear]
        weights = np.stack([constant, *terms], axis=1)
        # Of the sizes of all that is added up, cancelled parts included, many times what rounding can make of them.
        size = np.abs(np.log(model["n__0"])) + np.abs(np.log(model["n__1"])) + 1.0
        for c, x in zip(FEATURES, features):
            most = np.abs(x[np.isfinite(x)]).max(initial=0.0)
            for k in (0, 1):
                mean = model[f"{c}__sum__{k}"] / model[f"n__{k}"]
                var = np.maximum(model[f"{c}__sq__{k}"] / model[f"n__{k}"] - mean * mean, 1e-9)
                size = size + np.abs(np.log(var)) + (most + np.abs(mean)) ** 2 / var
        slack = 1e-12 * size
        hits = []
        for label in (1, 0):
            own = [x[labels == label] for x in features]
            n = len(own[0])
            sides = np.stack([np.ones(n), *[t for x in own for t in (x * x, x)]])
            sides[:, ~np.isfinite(sides).all(axis=0)] = np.nan  # neither sure nor never: judged one by one
            positive = np.zeros(len(slack), dtype=np.int64)
            for lo in range(0, len(slack), HELD):
                d, near = weights[lo : lo + HELD] @ sides, slack[lo : lo + HELD, None]
                sure, never = d < -near, d > near
                positive[lo : lo + HELD] = np.count_nonzero(sure, axis=1)
                open_ = np.count_nonzero(never, axis=1) + positive[lo : lo + HELD] < n
                for i in np.flatnonzero(open_):
                    at = ~(sure[i] | never[i])
                    exact = log_ratio({c: v[lo + i] for c, v in model.items()}, [x[at] for x in own])
                    # As in Spark a missing number is above one half.
                    positive[lo + i] += np.count_nonzero(~(1.0 / (1.0 + np.exp(exact)) < 0.5))
            hits.append((positive, n - positive))
    (tp, fn), (fp, tn) = hits
    return tp, fp, fn, tn


def audited(attempts: DataFrame, rows: DataFrame, base: DataFrame, val: DataFrame, first: DataFrame, axis: Axis) -> DataFrame:
    """Every attempt with its candidate's statistics and validation score, the verdict and the versions (written).

    `first`: series_id and first_metric, the score of the model that is in force before any candidate. A candidate is judged
    on all validation rows of its device.
    """
    keys, over = [*axis.series, "attempt"], Axis(axis.series, "attempt")
    wide = materialise(wide_models(candidates(attempts, rows, base, axis), axis), "candidates")
    got = metrics.scored_counts(judged(wide, val, axis), keys).select(*keys, F.col("f1").alias("candidate_metric"))
    table = attempts.hint("merge").join(got, keys).join(first, "series_id")
    # Written, as the gate reads it more than once.
    table = materialise(table.select(*keys, "trigger_idx", "candidate_metric", "first_metric"), "scores")
    gated = materialise(feedback.gate_sequence(table, over, MIN_METRIC, MARGIN), "gated")
    return materialise(feedback.version_audit(gated, over, F.col("accepted")).hint("merge").join(wide, keys), "cycles")


def first_metric(scored_val: DataFrame) -> DataFrame:
    return metrics.classification_metrics(scored_val, "y", "prediction", ["series_id"]).select("series_id", F.col("f1").alias("first_metric"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of every device, beginning with the baseline's own model."""

    def build() -> DataFrame:
        every = E.normalised(spark, sf_dir)
        base, val = every.where(F.col("role") == "baseline_train"), every.where(F.col("role") == "baseline_validation")
        first = first_metric(models.predict(val, models.nb_scorer(baseline_model(spark, sf_dir), FEATURES)))
        with passing(spark, "cycles"):
            return audited(triggers(spark, sf_dir), E.scored(spark, sf_dir), base, val, first, E.STREAM)

    return E.staged(spark, sf_dir, "cycles", build)


def in_force(rows: DataFrame, audit: DataFrame, axis: Axis) -> DataFrame:
    """`rows` with the statistics of the candidate in force as `model`: the newest accepted one, from the row after its trigger
    on; null before the first."""
    accepted = audit.where("accepted").select(
        *axis.series, (F.col("trigger_idx") + 1).alias(axis.idx), F.struct("active_version", *MODEL).alias("__model")
    )
    placed = materialise(rows.join(accepted.hint("merge"), [*axis.series, axis.idx], "left"), "placed")
    return axis.running(placed, lasts={"model": F.col("__model")}).drop("__model")


def retrained(spark: SparkSession, sf_dir: str, rows: DataFrame, axis: Axis, rule: Column, among: Column) -> DataFrame:
    """`rows` (FEATURES, y, severities) of the devices `among` with `retrained_pred`: the answer of a cloud model that is retrained as it goes.

    Drift fires a retraining, its candidate learns from the labels known by then, and if it holds its own against the model in
    force on the validation rows, it answers from the next row on; `rule` is the answer before. Triggers and training rows depend
    on inputs and label arrivals, so the only thing that is sequential is which candidate is in force, over the attempts.
    """
    every = E.normalised(spark, sf_dir).where(among)
    base, val = every.where(F.col("role") == "baseline_train"), every.where(F.col("role") == "baseline_validation")
    audit = audited(fired(rows, axis), rows, base, val, first_metric(val.withColumn("prediction", rule)), axis)
    held = in_force(rows, audit, axis)
    late = models.nb_posterior(FEATURES, lambda name, k: F.col(f"model.{name}__{k}"))
    return held.withColumn("retrained_pred", F.when(F.col("model").isNotNull(), (late >= 0.5).cast("int")).otherwise(rule)).drop("model")


def adapted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows answered by the version in force on each: the first model, then the
    newest accepted candidate of the device, from the row after its trigger on."""
    rows = E.scored(spark, sf_dir).select("series_id", "row_idx", "event_id", *FEATURES, "y")
    held = in_force(rows, cycles(spark, sf_dir), E.STREAM)
    first = models.nb_scorer(baseline_model(spark, sf_dir), FEATURES)(held)
    late = models.nb_posterior(FEATURES, lambda name, k: F.col(f"model.{name}__{k}"))
    p1 = F.when(F.col("model").isNotNull(), late).otherwise(F.col("p1"))
    return first.select(
        "series_id", "row_idx", "y", F.coalesce("model.active_version", F.lit("v1")).alias("model_version"),
        p1.alias("p1"), (p1 >= 0.5).cast("int").alias("prediction"),
    )
