"""Error feedback, routing controllers and two-tier scoring."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.signals import clip, confidence
from tidegauge.operators.ordering import Axis
from tidegauge.operators.speculative import SEGMENT_ROWS, speculative_fold

# Actions and default thresholds.
EDGE, HYBRID, CLOUD = "EDGE", "HYBRID", "CLOUD"
CRITICAL, CLOUD_BELOW, EDGE_FROM = 0.30, 0.50, 0.70
FALLBACK_CONFIDENCE = 0.60
# Static policies.
POLICIES = ("edge_only", "cloud_only", "static_hybrid", "round_robin", "fixed_ratio")


def error_ema(
    df: DataFrame, axis: Axis, loss: Column, alpha: float = 0.8, initial: float = 0.0, name: str = "error_ema"
) -> DataFrame:
    """Smoothed error that moves only on rows where a label arrived (`loss` not null).

    Arrivals are numbered, smoothed as their own dense sequence, and the latest value is
    carried forward over the rows in between. `df` is read several times: pass a written
    table or a cheap projection.
    """
    rows = df.withColumn("__loss", clip(loss.cast("double"), 0.0, 1.0))
    got = F.col("__loss").isNotNull()
    numbered = axis.running(
        rows.select(*axis.series, axis.idx, "__loss"), sums={"__k": got.cast("long")}
    ).where(got).withColumn("__k", F.col("__k") - 1)
    smooth = Axis(axis.series, "__k", axis.chunk_rows).ema(numbered, "__e", F.col("__loss"), alpha, initial)
    placed = df.join(smooth.select(*axis.series, axis.idx, "__e"), [*axis.series, axis.idx], "left")
    out = axis.running(placed, lasts={name: F.col("__e")})
    return out.withColumn(name, F.coalesce(name, F.lit(float(initial)))).drop("__e")


def delayed_error(df: DataFrame, values: dict, loss: Column, axis: Axis, delay: int, alpha: float = 0.8, initial: float = 0.0, name: str = "error_ema") -> DataFrame:
    """Smoothed error when every row's label arrives exactly `delay` rows later.

    The error at a row is then the smoothed loss as of `delay` rows before, so it shares one
    shuffle with the other smoothed `values`.
    """
    lagged = lambda w: F.coalesce(F.lag("__loss_ema", delay).over(w), F.lit(float(initial)))
    out = axis.emas(df, {**values, "__loss_ema": (loss, initial)}, alpha, {name: lagged}, back=delay)
    return out.drop("__loss_ema")


def route_hysteresis(
    df: DataFrame,
    axis: Axis,
    reliability: str = "reliability",
    initial: str = EDGE,
    hybrid: bool = True,
    critical: float = CRITICAL,
    cloud_below: float = CLOUD_BELOW,
    edge_from: float = EDGE_FROM,
    count_switches: bool = True,
) -> DataFrame:
    """Add action, previous_action, reason and switch_count of the three-state controller.

    No row loop: reliability at or above `edge_from` always leads to EDGE, below `critical`
    always to CLOUD, whatever the state was. The action in between follows from the last
    such anchor and from whether a hybrid-zone row came after it.
    """
    if not 0.0 <= critical < cloud_below < edge_from <= 1.0:
        raise ValueError("thresholds must satisfy 0 <= critical < cloud_below < edge_from <= 1")
    r = F.col(reliability)
    cloud_at = F.lit(critical if hybrid else cloud_below)
    anchor = F.when(r >= edge_from, F.lit(EDGE)).when(r < cloud_at, F.lit(CLOUD))
    mark = F.struct(anchor.alias("a"), F.col(axis.idx).alias("i"))
    zone = F.when((r >= critical) & (r < cloud_below), F.col(axis.idx))
    def action_of(anchor_at: str, zone_at: str) -> Column:
        base = F.coalesce(F.col(f"{anchor_at}.a"), F.lit(initial if hybrid or initial != HYBRID else CLOUD))
        since = F.coalesce(F.col(zone_at), F.lit(-1)) > F.coalesce(F.col(f"{anchor_at}.i"), F.lit(-1))
        return base if not hybrid else F.when((base == EDGE) & since, F.lit(HYBRID)).otherwise(base)

    lasts = {"__anchor": F.when(anchor.isNotNull(), mark), "__zone": zone}
    state = axis.running(df, lasts=lasts, before=True)
    # The previous row's action follows from the state before this row.
    earlier = F.when(F.col(axis.idx) == 0, F.lit(initial)).otherwise(action_of("__anchor__before", "__zone__before"))
    out = state.select(*df.columns, action_of("__anchor", "__zone").alias("action"), earlier.alias("previous_action"))
    out = out.withColumn(
        "reason", route_reason(r, F.col("previous_action"), F.col("action"), hybrid, critical, cloud_below, edge_from)
    )
    if not count_switches:
        return out
    return axis.running(out, sums={"switch_count": (F.col("action") != F.col("previous_action")).cast("long")})


def route_reason(
    r: Column, before: Column, now: Column, hybrid: bool, critical: float, cloud_below: float, edge_from: float
) -> Column:
    """Text of the transition taken."""
    shown = F.concat(F.lit("R_t ("), F.format_string("%.4f", r), F.lit(")"))
    c, b, e = f"{critical:.2f}", f"{cloud_below:.2f}", f"{edge_from:.2f}"
    say = lambda tail: F.concat(shown, F.lit(tail))
    # Reason texts.
    from_edge = (
        F.when(now == EDGE, say(f" >= cloud_threshold ({b}); maintain EDGE"))
        .when(now == HYBRID, say(f" in hybrid zone [{c}, {b}); transition EDGE -> HYBRID"))
        .otherwise(say(f" < critical_cloud_threshold ({c}); transition EDGE -> CLOUD"))
    )
    from_hybrid = (
        F.when(now == EDGE, say(f" >= edge_return_threshold ({e}); recover HYBRID -> EDGE"))
        .when(now == CLOUD, say(f" < critical_cloud_threshold ({c}); degrade HYBRID -> CLOUD"))
        .otherwise(say(" in hysteresis/hybrid zone; maintain HYBRID"))
    )
    from_cloud = F.when(now == EDGE, say(f" >= edge_return_threshold ({e}); recover CLOUD -> EDGE")).otherwise(
        say(f" < edge_return_threshold ({e}); maintain CLOUD")
    )
    return F.when(before == EDGE, from_edge).when(before == HYBRID, from_hybrid).otherwise(from_cloud)


def route_static(idx: Column, policy: str, ratio: float = 0.5) -> Column:
    """Action of a policy that looks at the row number only."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be in [0, 1]")
    if policy == "round_robin":
        return F.when(idx % 2 == 0, F.lit(EDGE)).otherwise(F.lit(CLOUD))
    if policy == "fixed_ratio":
        return F.when((idx * F.lit(float(ratio))) % 1.0 < ratio, F.lit(EDGE)).otherwise(F.lit(CLOUD))
    return F.lit({"edge_only": EDGE, "cloud_only": CLOUD, "static_hybrid": HYBRID}[policy])


def needs_cloud(action: Column, edge_confidence: Column, floor: float = FALLBACK_CONFIDENCE) -> Column:
    """Rows whose answer comes from the expensive model."""
    return (action == CLOUD) | ((action == HYBRID) & (edge_confidence < floor))


def two_tier_score(df: DataFrame, edge, cloud, key: list[str], action: str = "action", floor: float = FALLBACK_CONFIDENCE) -> DataFrame:
    """Score every row with the edge scorer and only the routed rows with the cloud scorer.

    A scorer maps a DataFrame to the same rows plus p0 and p1. The routed subset is scored
    on its own and joined back on `key`, so the expensive model sees no other row.
    """
    scored = edge(df).withColumnsRenamed({"p0": "edge_p0", "p1": "edge_p1"})
    sure = confidence(F.col("edge_p0"), F.col("edge_p1"))
    routed = scored.withColumn("__cloud", needs_cloud(F.col(action), sure, floor))
    heavy = cloud(routed.where("__cloud").select(*df.columns)).select(
        *key, F.col("p0").alias("cloud_p0"), F.col("p1").alias("cloud_p1")
    )
    both = routed.join(heavy, key, "left")
    p0, p1 = F.coalesce("cloud_p0", "edge_p0"), F.coalesce("cloud_p1", "edge_p1")
    fallback = (F.col(action) == HYBRID) & F.col("__cloud")
    # Names of the tier that answered.
    used = (
        F.when(F.col(action) == EDGE, F.lit("edge"))
        .when(F.col(action) == CLOUD, F.lit("cloud"))
        .when(fallback, F.lit("hybrid_cloud"))
        .otherwise(F.lit("hybrid_edge"))
    )
    return both.select(
        *df.columns,
        p0.alias("p0"),
        p1.alias("p1"),
        (p1 >= p0).cast("int").alias("prediction"),
        used.alias("model_used"),
        fallback.alias("cloud_fallback"),
        F.when(fallback, F.lit("FALLBACK")).otherwise(F.lit("SUCCESS")).alias("execution_status"),
    )


LOOP_FIELDS = T.StructType(
    [
        T.StructField("error_ema", T.DoubleType()),
        T.StructField("reliability", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("cloud_fallback", T.BooleanType()),
    ]
)


#: Rows after which a smoothed error has forgotten where it began, beside the delay of its labels.
FORGETS = 256


class Controller:
    """The adaptive controller with its own answers fed back, as a machine."""

    outputs = LOOP_FIELDS

    def __init__(self, delay: int, alpha: float, floor: float, epsilon: float, warm: int):
        self.delay, self.alpha, self.floor, self.epsilon, self.warm = delay, alpha, floor, epsilon, warm

    def start(self) -> tuple:
        return 0.0, EDGE, deque()

    def step(self, state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        error, action, waiting = state
        out = []
        for conf, drift, quality, by_edge, by_cloud, sure, label in zip(
            *(part[c].tolist() for c in ("confidence", "drift", "quality", "edge_pred", "cloud_pred", "edge_conf", "label"))
        ):
            if len(waiting) == self.delay:
                error = self.alpha * error + (1.0 - self.alpha) * waiting.popleft()
            parts = (conf, 1.0 - error, 1.0 - drift, quality)
            r = 1.0 / sum(0.25 / (min(max(p, 0.0), 1.0) + self.epsilon) for p in parts)
            r = min(max(r, 0.0), 1.0)
            if r >= EDGE_FROM:
                action = EDGE
            elif r < CRITICAL:
                action = CLOUD
            elif r < CLOUD_BELOW and action == EDGE:
                action = HYBRID
            fallback = action == HYBRID and sure < self.floor
            answer = by_cloud if action == CLOUD or fallback else by_edge
            waiting.append(float(answer != label))
            out.append((error, r, action, int(answer), fallback))
        return (error, action, waiting), pd.DataFrame(out, columns=LOOP_FIELDS.names)

    def frozen(self, state: tuple) -> bytes:
        error, action, waiting = state
        return np.array([error, (EDGE, HYBRID, CLOUD).index(action), *waiting], dtype="<f8").tobytes()

    def thawed(self, data: bytes) -> tuple:
        error, action, *waiting = np.frombuffer(data, dtype="<f8").tolist()
        return error, (EDGE, HYBRID, CLOUD)[int(action)], deque(waiting)


def closed_loop(
    df: DataFrame,
    axis: Axis,
    delay: int = 15,
    alpha: float = 0.8,
    floor: float = FALLBACK_CONFIDENCE,
    epsilon: float = 1e-8,
    policy: str = "policy",
    segment_rows: int = SEGMENT_ROWS,
    last_index: int | None = None,
    warm: int = FORGETS,
) -> DataFrame:
    """Routing whose own answers feed back: the label of row t-delay scores the answer given
    then, which moves the error, the reliability and so the next action.

    Needs confidence, drift, quality, edge_pred, cloud_pred, edge_conf, label and a policy
    column (adaptive, edge_only, cloud_only). A constant policy's answers don't depend on the
    error, so its runs are a delayed smoothing. The adaptive one is a recursion without a closed
    form, but one that forgets: segments of a series run at once, each after a warm-up, and those
    whose assumed state turns out wrong run again. `df` is read twice: write an expensive one first.
    """
    rule, constant = F.col(policy), F.col(policy).isin("edge_only", "cloud_only")
    in_cloud = rule == "cloud_only"
    answer = F.when(in_cloud, F.col("cloud_pred")).otherwise(F.col("edge_pred"))
    loss = F.coalesce((answer != F.col("label")).cast("double"), F.lit(1.0))
    fixed = delayed_error(df.where(constant), {}, loss, axis, delay, alpha)
    parts = [F.col("confidence"), F.lit(1.0) - F.col("error_ema"), F.lit(1.0) - F.col("drift"), F.col("quality")]
    r = F.lit(1.0) / sum((F.lit(0.25) / (clip(p, 0.0, 1.0) + F.lit(epsilon)) for p in parts), F.lit(0.0))
    fixed = fixed.select(
        *df.columns, "error_ema", clip(r, 0.0, 1.0).alias("reliability"), F.when(in_cloud, F.lit(CLOUD)).otherwise(F.lit(EDGE)).alias("action"),
        answer.cast("int").alias("prediction"), F.lit(False).alias("cloud_fallback"),
    )
    machine = Controller(delay, alpha, floor, epsilon, delay + warm)
    moving = speculative_fold(df.where(~constant), axis, machine, segment_rows, last_index).rows
    return fixed.unionByName(moving.select(*fixed.columns))
