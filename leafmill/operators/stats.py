"""Counters, histograms, gauges and load-test summaries over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets; the last one is unbounded.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(events: DataFrame, value: Column, *labels: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts per bound, count and sum: one pass, one row per label."""
    v = value
    cumulative = [F.count(F.when(v <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return events.groupBy(*labels).agg(*cumulative, F.count(v).alias("n"), F.sum(v.cast("decimal(38,6)")).alias("total"))


def gauges(events: DataFrame, value: str, order: Column, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


#: Value ranges of a rank over all samples; their sums, one row each, are broadcast.
RANK_BUCKETS = 4_096


def nearest_rank(samples: DataFrame, value: str, percents: tuple[int, ...], *labels: str) -> DataFrame:
    """sorted[min(n * p div 100, n - 1)] per label, exact. Values are counted first, so a label with any
    number of samples is a prefix sum over its different values rather than one array."""
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("c"))
    if labels:
        w = Window.partitionBy(*labels).orderBy(value)
        whole = Window.partitionBy(*labels)
        placed = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(whole))
    else:
        # Prefix sums inside value buckets, and of the buckets' sums: no task sees all values.
        low, high = counted.agg(F.min(value), F.max(value)).first()
        step = max((float(high or 0) - float(low or 0)) / RANK_BUCKETS, 1e-9)
        bucketed = counted.withColumn("bucket", F.floor((F.col(value).cast("double") - F.lit(float(low or 0))) / F.lit(step)))
        sums = bucketed.groupBy("bucket").agg(F.sum("c").alias("in_bucket"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"), F.sum("in_bucket").over(Window.partitionBy()).alias("n"))
        own = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        placed = bucketed.join(F.broadcast(sums), "bucket").withColumn("upto", F.col("before") + F.sum("c").over(own))
    rank = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return placed.groupBy(*labels).agg(*[F.min(F.when(F.col("upto") > rank(p), F.col(value))).alias(f"p{p}") for p in percents])


def step_summary(samples: DataFrame, seconds: float) -> DataFrame:
    """samples: step, latency_ms (long), status. A request fails on status 0 or from 500."""
    failed = F.count(F.when((F.col("status") == 0) | (F.col("status") >= 500), 1))
    sums = samples.groupBy("step").agg(
        F.count("*").alias("total"),
        failed.alias("failed"),
        F.round(failed * 100.0 / F.count("*"), 1).alias("error_pct"),
        F.round(F.sum("latency_ms") / F.count("*"), 3).alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.round(F.count("*") / F.lit(seconds), 1).alias("rps"),
    )
    return sums.join(nearest_rank(samples, "latency_ms", (50, 95, 99), "step"), "step")


def tool_summary(samples: DataFrame) -> DataFrame:
    """Per tool; here a request fails on any status but 200."""
    sums = samples.groupBy("tool").agg(F.count("*").alias("total"), F.count(F.when(F.col("status") != 200, 1)).alias("failed"))
    return sums.join(nearest_rank(samples, "latency_ms", (50, 95, 99), "tool"), "tool")


def recommended(steps: DataFrame, max_error_pct: float = 10.0, max_p99: float = 10_000.0) -> DataFrame:
    """The last step with few errors and a short tail; else the first."""
    good = (F.col("error_pct") < max_error_pct) & (F.col("p99") < max_p99)
    return steps.agg(F.coalesce(F.max(F.when(good, F.col("step"))), F.min("step")).alias("concurrency"))


def first_breach(cpu: Column, memory: Column, error_pct: Column, p99: Column, limits: tuple[float, float, float, float] = (200, 90, 20, 10_000)) -> Column:
    """The first limit reached, in fixed order; null within all."""
    c, m, e, p = limits
    return F.when(cpu >= c, "cpu").when(memory >= m, "memory").when(error_pct >= e, "error_rate").when(p99 >= p, "p99")


def exposition(counted: DataFrame, name: str, *labels: str) -> DataFrame:
    """Counters in the text format that scrapers read, a line per series."""
    pairs = [F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels]
    body = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit("")
    return counted.select(F.concat(F.lit(name), body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def load_plan(draws: DataFrame, tools: tuple[str, ...], model_tool: str, instead: str, max_model_calls: int, first: int = 2, last: int = 50, step: int = 2) -> DataFrame:
    """draws: request (order), stage (from 0). The requests of a load test: connections ramp up by stage,
    tools take turns with equal weight, and of a stage's calls of the model only so many stay; the
    others become calls of another tool."""
    concurrency = F.least(F.lit(last), F.lit(first) + F.col("stage") * step)
    drawn = F.element_at(F.array(*map(F.lit, tools)), (F.pmod(F.col("request"), F.lit(len(tools))) + 1).cast("int"))
    # The k-th call of the model in its stage: tools take turns, so it follows from the place among that stage's calls.
    nth = F.row_number().over(Window.partitionBy("stage", "drawn").orderBy("request"))
    tool = F.when((F.col("drawn") == model_tool) & (nth > max_model_calls), instead).otherwise(F.col("drawn"))
    return draws.withColumn("drawn", drawn).select("request", "stage", concurrency.alias("concurrency"), tool.alias("tool"))
