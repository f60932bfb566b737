"""Events aggregated over look-back windows before a decision time.

An event counts for a window of ``d`` days if ``decision - d < time <= decision``. A window of whole days is the part of its
first day after the decision's clock time, the whole days between, and the part of its last day up to that time. So
three small things are enough, for any number of decision times:

* Events are reduced to **segments**: per entity and minute, cut at the decision times (and the same times ``d`` days before) that
  fall into this minute. Minutes without a cut are one segment. Spark reduces before it shuffles, so an entity, a day or a
  minute with a third of all events costs a few rows per task.
* Inside a **day** running sums over segments give the part up to each cut, and from the other end the part after it. A day
  has at most 1440 minutes, whatever the number of events.
* Over **days** a window over one row per day gives the whole days between.

The three parts of each (decision time, window) are added up. There is one plan, and nothing is looked up before it is made.
Decision times, days and parts are dealt out by the size of the input, so a task sorts the same rows at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.text import epoch_micros
from tidepanel.scale import spread

DAY_MICROS = 86_400_000_000
MINUTE_MICROS = 60_000_000


@dataclass(frozen=True)
class SlotMeasures:
    """What to keep per slot, and how a run of slots is read out."""

    sums: Mapping[str, Column] = field(default_factory=dict)
    maxima: Mapping[str, Column] = field(default_factory=dict)
    minima: Mapping[str, Column] = field(default_factory=dict)
    latest: Sequence[str] = ()


def _floor_div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")


def windowed_events(
    samples: DataFrame,
    events: DataFrame,
    windows: Sequence[int],
    measures: SlotMeasures,
    entity: str | None = None,
    time: str = "publish_time",
    decision: str = "decision_ts",
    tie: str = "news_id",
) -> DataFrame:
    """Per sample and window the count of events and the measures, as ``<name>_<d>d``.

    ``entity`` limits a sample to its own events; without it every sample sees all
    events. Latest values are those of the last event by time, then by ``tie``.
    ``hours_since_latest`` comes with them.
    """
    key = F.col(entity).cast("string") if entity else F.lit("all")
    asked = samples.where(F.col(decision).isNotNull()).select(
        "sample_id", key.alias("_entity"), epoch_micros(decision).alias("_at")
    )
    # what each decision needs: the part up to it (window 0), and per window the part after the same time d days before
    times = spread(asked.select("_entity", "_at"), "_entity", "_at").distinct()
    back = F.explode(F.array(F.lit(0), *[F.lit(d) for d in windows])).alias("_d")
    needs = times.select("_entity", "_at", back).withColumn("_cut", F.col("_at") - F.col("_d") * DAY_MICROS)
    needs = spread(needs.withColumn("_minute", _floor_div(F.col("_cut"), MINUTE_MICROS)), "_entity", "_minute")

    stamped = events.where(F.col(time).isNotNull()).select(
        key.alias("_entity"),
        epoch_micros(time).alias("_time"),
        F.col(tie).alias("_tie"),
        *[c.cast("double").alias(n) for n, c in measures.sums.items()],
        *[c.cast("double").alias(n) for n, c in measures.maxima.items()],
        *[c.cast("double").alias(n) for n, c in measures.minima.items()],
        *[F.col(n).alias(f"_last_{n}") for n in measures.latest],
    )
    segments = _segments(stamped, needs, measures)
    names = [c for c in segments.columns if c not in ("_entity", "_day", "_minute", "_segment")]
    read = {n: F.sum if n in measures.sums or n == "count" else F.min if n in measures.minima else F.max for n in names}

    parts = _parts_of_days(segments, needs, read).unionByName(_whole_days(segments, times, windows, read))
    wide = {f"{n}_{d}d": read[n](F.when((F.col("_d") == d) | (F.col("_d") == 0), F.col(n))) for d in windows for n in names}
    seen = spread(parts, "_entity", "_at").groupBy("_entity", "_at").agg(*[x.alias(n) for n, x in wide.items()])

    out = asked.join(seen, ["_entity", "_at"], "left")
    final = {}
    for d in windows:
        final[f"count_{d}d"] = F.coalesce(F.col(f"count_{d}d"), F.lit(0)).cast("double")
        if measures.latest:
            last = F.col(f"latest_{d}d")
            for name in measures.latest:
                final[f"latest_{name}_{d}d"] = last[name]
            final[f"hours_since_latest_{d}d"] = (F.col("_at") - last["_time"]) / F.lit(3_600_000_000.0)
    out = out.withColumns(final)
    return out.drop("_entity", "_at", *([f"latest_{d}d" for d in windows] if measures.latest else []))


def _segments(stamped: DataFrame, needs: DataFrame, measures: SlotMeasures) -> DataFrame:
    """One row per entity, minute and segment: what lies between two neighbouring cuts of the minute, the later one included."""
    cuts = needs.groupBy("_entity", "_minute").agg(F.collect_set("_cut").alias("_cuts"))
    placed = stamped.withColumn("_minute", _floor_div(F.col("_time"), MINUTE_MICROS)).join(cuts, ["_entity", "_minute"], "left")
    earlier = F.size(F.filter("_cuts", lambda c: c < F.col("_time")))
    placed = placed.withColumn("_segment", F.when(F.col("_cuts").isNull(), 0).otherwise(earlier))
    aggregates = [F.count(F.lit(1)).alias("count")]
    aggregates += [F.sum(n).alias(n) for n in measures.sums]
    aggregates += [F.max(n).alias(n) for n in measures.maxima]
    aggregates += [F.min(n).alias(n) for n in measures.minima]
    if measures.latest:
        last = F.struct("_time", "_tie", *[F.col(f"_last_{n}").alias(n) for n in measures.latest])
        aggregates.append(F.max(last).alias("latest"))
    reduced = placed.groupBy("_entity", "_minute", "_segment").agg(*aggregates)
    return reduced.withColumn("_day", _floor_div(F.col("_minute"), DAY_MICROS // MINUTE_MICROS))


def _parts_of_days(segments: DataFrame, needs: DataFrame, read: Mapping[str, Callable]) -> DataFrame:
    """Measures of the last day up to each decision, and of each window's first day after the decision's clock time."""
    place = Window.partitionBy("_entity", "_minute").orderBy("_cut")
    # the segment that ends at this cut; equal cuts of several needs share it
    asked = needs.withColumn("_segment", (F.dense_rank().over(place) - 1).cast("int"))
    asked = asked.withColumn("_day", _floor_div(F.col("_minute"), DAY_MICROS // MINUTE_MICROS)).drop("_cut")
    line = spread(segments.unionByName(asked, allowMissingColumns=True), "_entity", "_day")
    until = Window.partitionBy("_entity", "_day").orderBy("_minute", "_segment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a need stands after its segment; seen from the other end, before the next one
    after = (
        Window.partitionBy("_entity", "_day")
        .orderBy(F.col("_minute").desc(), F.col("_segment").desc(), F.col("_at").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = {n: F.when(F.col("_d") == 0, f(n).over(until)).otherwise(f(n).over(after)) for n, f in read.items()}
    return line.select("_entity", "_at", "_d", *[v.alias(n) for n, v in values.items()]).where(F.col("_at").isNotNull())


def _whole_days(segments: DataFrame, times: DataFrame, windows: Sequence[int], read: Mapping[str, Callable]) -> DataFrame:
    """Measures of the whole days between the first and the last day of each window."""
    days = segments.groupBy("_entity", "_day").agg(*[f(n).alias(n) for n, f in read.items()])
    asked = times.withColumn("_day", _floor_div(F.col("_at"), DAY_MICROS))
    line = spread(days.unionByName(asked, allowMissingColumns=True), "_entity")
    order = Window.partitionBy("_entity").orderBy("_day")
    between = F.array(
        *[
            F.struct(F.lit(d).alias("_d"), *[f(n).over(order.rangeBetween(1 - d, -1)).alias(n) for n, f in read.items()])
            for d in windows
            if d > 1
        ]
    )
    if max(windows) <= 1:
        return line.where(F.lit(False)).withColumn("_d", F.lit(0)).select("_entity", "_at", "_d", *read)
    line = line.withColumn("_w", between).where(F.col("_at").isNotNull())
    return line.select("_entity", "_at", F.explode("_w").alias("_w")).select("_entity", "_at", "_w.*")
