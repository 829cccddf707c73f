"""Late labels, retraining triggers, candidate gating and version history."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.checks import leakage_guard
from tidegauge.operators.detect import ordered_fold
from tidegauge.operators.metrics import classification_metrics
from tidegauge.operators.ordering import Axis

# Default limits of the adaptation rules.
MIN_SEVERITY, MIN_FEEDBACK, COOLDOWN, MAX_FEEDBACK, BUFFER = 0.30, 25, 50, 1000, 2000
MIN_METRIC, MAX_REGRESSION = 0.70, 0.05


def delayed_feedback(predictions: DataFrame, arrivals: DataFrame, axis: Axis) -> DataFrame:
    """Attach late labels to their predictions; `causal` is false where a label came too early.

    `arrivals` holds (series, observation index, label, arrival_index). Of several labels for
    one observation the one that arrived last counts, so a prediction stays one row.
    """
    keys = [*axis.series, axis.idx]
    values = [c for c in arrivals.columns if c not in keys]
    newest = arrivals.groupBy(*keys).agg(F.max_by(F.struct(*values), "arrival_index").alias("__newest"))
    joined = predictions.join(newest.select(*keys, "__newest.*"), keys, "left")
    return joined.withColumns(
        {
            "is_labeled": F.col("arrival_index").isNotNull(),
            "causal": F.coalesce(F.col("arrival_index") >= F.col(axis.idx), F.lit(True)),
        }
    )


def eligible_feedback(
    feedback: DataFrame, axis: Axis, as_of: Column, max_samples: int = MAX_FEEDBACK, buffer: int = BUFFER
) -> DataFrame:
    """Newest `max_samples` causal labels per series that had arrived by `as_of`.

    The buffer holds the newest `buffer` observations up to `as_of`. Newness is counted from
    the end with running totals, so no series is sorted in one task.
    """
    ok = (
        F.col("is_labeled") & F.col("causal") & (F.col("arrival_index") <= as_of)
        & (F.col(axis.idx) <= as_of) & (F.col(axis.idx) > as_of - buffer)
    )
    marked = feedback.withColumn("__ok", ok)
    seen = axis.running(marked, sums={"__seen": F.col("__ok").cast("long")})
    totals = marked.groupBy(*axis.series).agg(F.count_if("__ok").alias("__all"))
    return (
        seen.where("__ok")
        .join(totals, list(axis.series))
        .where(F.col("__all") - F.col("__seen") < max_samples)
        .drop("__ok", "__seen", "__all")
    )


def eligible_count_asof(rows: DataFrame, feedback: DataFrame, axis: Axis, buffer: int = BUFFER) -> DataFrame:
    """Add `n_eligible`: labels in the buffer that had arrived by each row.

    A label adds one at its arrival and leaves when the buffer moves past its observation;
    labels for evicted observations are refused. The two kinds of event are summed per row
    and accumulated, so no row meets more than the events at its own index.
    """
    idx = F.col(axis.idx)
    usable = feedback.where(
        F.col("is_labeled") & F.col("causal") & (F.col("arrival_index") < idx + buffer)
    )
    event = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).cast("long").alias("d"))
    steps = (
        usable.select(*axis.series, F.inline(F.array(event(F.col("arrival_index"), 1), event(idx + buffer, -1))))
        .groupBy(*axis.series, F.col("at").alias(axis.idx))
        .agg(F.sum("d").alias("__d"))
    )
    placed = rows.join(steps, [*axis.series, axis.idx], "left")
    return axis.running(placed, sums={"n_eligible": F.coalesce("__d", F.lit(0))}).drop("__d")


TRIGGER_FIELDS = T.StructType([T.StructField("fired", T.BooleanType())])


def adaptation_triggers(
    rows: DataFrame,
    axis: Axis,
    persistent: str = "is_persistent",
    severity: str = "smoothed_severity",
    eligible: str = "n_eligible",
    min_severity: float = MIN_SEVERITY,
    min_feedback: int = MIN_FEEDBACK,
    cooldown: int = COOLDOWN,
) -> DataFrame:
    """Add `fired`, `state` and `reason` to every row.

    Only rows that meet every condition but the cooldown enter the ordered fold, which keeps
    one number (the last firing) per series.
    """
    ready = (
        F.col(persistent) & (F.col(severity) >= min_severity) & (F.col(eligible) >= min_feedback)
    )
    marked = rows.withColumn("__ready", F.coalesce(ready, F.lit(False)))
    numbered = axis.running(
        marked.select(*axis.series, axis.idx, "__ready"), sums={"__k": F.col("__ready").cast("long")}
    )
    candidates = numbered.where("__ready").select(*axis.series, axis.idx, (F.col("__k") - 1).alias("__k"))

    def step(last, part: pd.DataFrame):
        fired = []
        for at in part[axis.idx].tolist():
            hit = last is None or at - last >= cooldown
            last = at if hit else last
            fired.append(hit)
        return last, pd.DataFrame({"fired": fired})

    fires = ordered_fold(candidates, Axis(axis.series, "__k", axis.chunk_rows), lambda: None, step, TRIGGER_FIELDS)
    # A merge join: candidates grow with the rows, and their size is guessed.
    placed = marked.join(fires.select(*axis.series, axis.idx, "fired").hint("merge"), [*axis.series, axis.idx], "left")
    placed = placed.withColumn("fired", F.coalesce("fired", F.lit(False)))
    known = axis.running(placed, lasts={"__last": F.when(F.col("fired"), F.col(axis.idx))})
    since = F.col(axis.idx) - F.col("__last")
    cooling = ~F.col("fired") & F.coalesce(since < cooldown, F.lit(False))
    # States and reasons.
    reason = (
        F.when(F.col("fired"), F.lit("eligible"))
        .when(cooling, F.concat(F.lit("cooldown:"), (F.lit(cooldown) - since).cast("string")))
        .when(~F.col(persistent), F.lit("not_persistent"))
        .when(F.col(severity) < min_severity, F.lit("low_severity"))
        .otherwise(F.lit("few_samples"))
    )
    state = F.when(F.col("fired"), F.lit("ELIGIBLE")).when(cooling, F.lit("COOLDOWN")).otherwise(F.lit("IDLE"))
    return known.withColumns({"reason": reason, "state": state}).drop("__ready", "__last")


def stratified_sample(df: DataFrame, label: str, per_class: Mapping[int, int], order: Column) -> DataFrame:
    """A fixed number of rows per class, smallest `order` first (a hash of the row key), in one scan for any number of classes.

    Every task keeps the smallest rows of each class that it has seen and passes on only those, at most as many per class as are
    asked for; what meets in the end is that much from each task, so a class with nearly all rows is never sorted whole. Of
    equal `order` values any may stay. A class that `per_class` does not name is left out.
    """
    columns = [c for c in df.columns]
    wanted = F.create_map(*[x for c, n in per_class.items() for x in (F.lit(c), F.lit(n))])
    tagged = df.where(F.col(label).isin(*per_class)).withColumn("__order", order).withColumn("__want", wanted[F.col(label)])
    most = max(per_class.values())

    def smallest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            both = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = both.sort_values("__order", kind="stable").groupby(label, sort=False).head(most).reset_index(drop=True)
        if held is not None:
            yield held

    few = tagged.mapInPandas(smallest, tagged.schema)
    w = Window.partitionBy(label).orderBy("__order")
    return few.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= F.col("__want")).select(*columns)


def training_union(baseline: DataFrame, feedback: DataFrame) -> DataFrame:
    """Baseline sample and eligible feedback as one training set, with their origin."""
    return baseline.withColumn("origin", F.lit("baseline")).unionByName(
        feedback.withColumn("origin", F.lit("feedback"))
    )


def retraining(rows: DataFrame, features: Sequence[str], version: str, parent: str, seed: int, minimum: int = MIN_FEEDBACK, most: int = MAX_FEEDBACK) -> DataFrame:
    """The metadata row of a retraining on a `training_union`; too few labels, or more than the buffer gives, are refused."""
    leakage_guard(features)
    late = F.col("feedback_samples_used")
    reason = F.when(late < minimum, F.lit("too few labels")).when(late > most, F.lit("more labels than the buffer holds"))
    out = rows.agg(
        F.lit(version).alias("candidate_version"), F.lit(parent).alias("parent_version"), F.count("*").alias("total_samples_trained"),
        F.count_if(F.col("origin") == "baseline").alias("baseline_samples_used"), F.count_if(F.col("origin") == "feedback").alias("feedback_samples_used"),
        F.lit(len(features)).alias("feature_count"), F.lit(seed).alias("random_seed"),
    )
    return out.withColumn("status", F.when(reason.isNull(), F.lit("TRAINED")).otherwise(F.lit("REFUSED"))).withColumn("reason", reason)


def candidate_gate(
    scored: DataFrame,
    candidate: str = "candidate_pred",
    active: str = "active_pred",
    label: str = "label",
    by: Sequence[str] = (),
    metric: str = "f1",
    minimum: float = MIN_METRIC,
    margin: float = MAX_REGRESSION,
    role: str | None = None,
    validation_role: str = "baseline_validation",
) -> DataFrame:
    """Accept a candidate that is good enough and not clearly worse than the active model.

    Both are scored on the validation role only. Many candidates are judged at once by `by`.
    """
    rows = scored.where(F.col(role) == validation_role) if role else scored
    one = lambda pred, name: classification_metrics(rows, label, pred, by).select(
        *by, F.col(metric).alias(name), F.col("sample_count").alias(f"__n_{name}")
    )
    a, b = one(candidate, "candidate_metric"), one(active, "active_metric")
    both = a.join(b, list(by)) if by else a.join(b, F.lit(True))
    got, base = F.col("candidate_metric"), F.col("active_metric")
    reason = F.when(got < minimum, F.lit("below_minimum")).when(
        got < base - margin, F.lit("regression")
    ).otherwise(F.lit("accepted"))
    return both.select(
        *by, got, base, (got - base).alias("metric_delta"),
        F.col("__n_candidate_metric").alias("validation_samples"), reason.alias("reason"),
        F.when(reason == "accepted", F.lit("ACCEPTED")).otherwise(F.lit("REJECTED")).alias("status"),
    )


GATE_FIELDS = T.StructType([T.StructField("active_metric", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def gate_sequence(attempts: DataFrame, axis: Axis, minimum: float = MIN_METRIC, margin: float = MAX_REGRESSION) -> DataFrame:
    """Gate attempts in order, each against the model then in force.

    Needs `candidate_metric` and `first_metric` (the first model's score). An accepted
    candidate's score becomes the one to hold, which is all the state there is.
    """

    def step(active, part: pd.DataFrame):
        out = []
        for got, first in zip(part["candidate_metric"].tolist(), part["first_metric"].tolist()):
            base = first if active is None else active
            ok = got >= minimum and got >= base - margin
            out.append((base, ok))
            active = got if ok else active
        return active, pd.DataFrame(out, columns=[f.name for f in GATE_FIELDS.fields])

    return ordered_fold(attempts, axis, lambda: None, step, GATE_FIELDS)


def version_audit(attempts: DataFrame, axis: Axis, accepted: Column) -> DataFrame:
    """Lineage of deployment attempts: version, parent, status and the version active after each.

    Version v1 is the first model; attempt k proposes v(k+2) counting accepted ones before it,
    as an accepted candidate is what moves the number on.
    """
    done = axis.running(attempts.withColumn("__ok", accepted), sums={"__n": F.col("__ok").cast("long")})
    before = F.col("__n") - F.col("__ok").cast("long")
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    return done.withColumns(
        {
            "version": name(before + 2),
            "parent_version": name(before + 1),
            "active_version": name(F.col("__n") + 1),
            "status": F.when(F.col("__ok"), F.lit("ACTIVE")).otherwise(F.lit("REJECTED")),
        }
    ).drop("__ok", "__n")


def active_versions(audit: DataFrame, axis: Axis) -> DataFrame:
    """Version in force at the end, and how often it changed."""
    return audit.groupBy(*axis.series).agg(
        F.max_by("active_version", axis.idx).alias("active_version"),
        F.count("*").alias("n_attempts"),
        F.count_if(F.col("status") == "ACTIVE").alias("version_update_count"),
    )
