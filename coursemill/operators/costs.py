"""Prices, costs and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds of the histogram buckets
STAGE_BOUNDS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)  # seconds
LATENCY_BOUNDS = (250, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10_000, 15_000, 20_000, 30_000)  # milliseconds


def price_asof(usage: DataFrame, prices: DataFrame, date: str) -> DataFrame:
    """usage with the price of its model in force on its date: the last listed since then; null for an unknown model."""
    names = [c for c in prices.columns if c not in ("model", "since", "ord")]
    days = prices.select("model", "since").distinct()
    older = prices.withColumnsRenamed({"model": "_m", "since": "_s"})
    # of the prices listed by a day the last one counts, and it holds until the next day with a price: one row a day
    listed = days.join(older, (F.col("_m") == F.col("model")) & (F.col("_s") <= F.col("since"))).groupBy("model", "since").agg(F.max_by(F.struct(*names), "ord").alias("_p"))
    until = F.lead("since").over(Window.partitionBy("model").orderBy("since"))
    ranges = listed.select(F.col("model").alias("_model"), F.col("since").alias("_since"), until.alias("_until"), *[F.col(f"_p.{n}").alias(n) for n in names])
    day = F.to_date(date)
    held = (F.col("model") == F.col("_model")) & (day >= F.col("_since")) & (F.col("_until").isNull() | (day < F.col("_until")))
    return usage.join(F.broadcast(ranges), held, "left").drop("_model", "_since", "_until")  # a price list is small


def token_cost(input_tokens: Column, output_tokens: Column, audio_tokens: Column | None = None, tool_tokens: Column | None = None, thinking_tokens: Column | None = None) -> Column:
    """US dollars at the row's prices per million tokens.

    The prompt is input and audio; past the long-context threshold the long rates hold, where the model has any. Audio is
    priced apart only where the model prices it. What tools add counts as input but not towards the threshold, and
    thinking counts as output. Columns: input, output and, with any of the last three arguments, input_audio,
    long_context_threshold, long_input, long_output.
    """
    if audio_tokens is None and tool_tokens is None and thinking_tokens is None:
        return (input_tokens * F.col("input") + output_tokens * F.col("output")) / 1e6
    audio, tools, thinking = (F.coalesce(c, F.lit(0)) if c is not None else F.lit(0) for c in (audio_tokens, tool_tokens, thinking_tokens))
    long = F.coalesce(input_tokens + audio > F.col("long_context_threshold"), F.lit(False))
    rate = F.when(long & (F.col("long_input") > 0), F.col("long_input")).otherwise(F.col("input"))
    out = F.when(long & (F.col("long_output") > 0), F.col("long_output")).otherwise(F.col("output"))
    return ((input_tokens + tools) * rate + audio * F.coalesce("input_audio", rate) + (output_tokens + thinking) * out) / 1e6


def run_cost(stages: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of the stages a run computed (cached ones are free) and of all its stages; null if a model is unknown."""
    priced = price_asof(stages, prices, "started_at").withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens")))
    computed = F.sum(F.when(~F.col("cached"), F.col("cost")).otherwise(0.0))
    unknown = F.max((F.col("cost").isNull() & ~F.col("cached")).cast("int")) == 1
    return priced.groupBy("run_id").agg(F.when(~unknown, computed).alias("cost"), F.sum("cost").alias("all_in"))


def answer_cost(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """shown: null when unknown; charged to the ledger: 0 then."""
    priced = price_asof(messages, prices, "started_at").withColumn("shown", token_cost(F.col("input_tokens"), F.col("output_tokens")))
    return priced.withColumn("charged", F.coalesce("shown", F.lit(0.0)))


def first_uncached_stage(stages: DataFrame, stage: str, newest: int = 20) -> DataFrame:
    """Seconds of a stage in the oldest of a lecture's newest runs that really ran it."""
    runs = stages.select("lecture_id", "run_id", "started_at").distinct()
    listed = runs.withColumn("_n", F.row_number().over(Window.partitionBy("lecture_id").orderBy(F.desc("started_at"), F.desc("run_id")))).where(F.col("_n") <= newest)
    ran = stages.where((F.col("stage") == stage) & ~F.col("cached")).join(listed.select("lecture_id", "run_id"), ["lecture_id", "run_id"], "left_semi")
    return ran.groupBy("lecture_id").agg(F.min_by("seconds", F.struct("started_at", "run_id", "part")).alias("seconds"))


def real_time_factor(stages: DataFrame, lectures: DataFrame, stage: str = "asr", newest: int = 20) -> DataFrame:
    """(lecture_id, seconds, real_time_factor) of lectures (lecture_id, duration_s): a stage's seconds over those of the video.

    Null where the stage never really ran, and the factor also where it took no time or the video has no length.
    """
    rows = lectures.join(first_uncached_stage(stages, stage, newest), "lecture_id", "left")
    known = (F.col("seconds") != 0) & (F.col("duration_s") != 0)
    return rows.select("lecture_id", "seconds", F.when(known, F.col("seconds") / F.col("duration_s")).alias("real_time_factor"))


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """Number of bounds below a value."""
    return sum(((value > b).cast("int") for b in bounds), F.lit(0))


def stage_stats(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage", "cached").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"))


def cache_hits(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.avg(F.col("cached").cast("double")).alias("hits"))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    return rows.groupBy(*by, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def llm_usage_stats(calls: DataFrame) -> DataFrame:
    """Tokens by (model, purpose, direction) of calls that ran."""
    sums = calls.where(~F.col("cached")).groupBy("model", "purpose").agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))
    return sums.unpivot(["model", "purpose"], ["input", "output"], "direction", "tokens")


def llm_cost_stats(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, purpose, cost) of calls that ran, at the prices of their day; calls of a model without a price cost nothing."""
    priced = price_asof(calls.where(~F.col("cached")), prices, "started_at")
    return priced.groupBy("model", "purpose").agg(F.sum(F.coalesce(token_cost(F.col("input_tokens"), F.col("output_tokens")), F.lit(0.0))).alias("cost"))


def latency_histograms(messages: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, bucket, n): answers by time to the first token and to the end (first_token_ms, total_ms), in buckets."""
    long = messages.unpivot(by, ["first_token_ms", "total_ms"], "metric", "ms").where("ms is not null")
    return histogram(long, "ms", LATENCY_BOUNDS, [*by, "metric"])


def latency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"))


def cost_per_hour(stages: DataFrame, prices: DataFrame, lectures: DataFrame) -> DataFrame:
    """LLM cost and processing seconds of a lecture-hour, cached calls included. lectures: lecture_id, duration_s."""
    priced = price_asof(stages, prices, "started_at").withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens")))
    spent = priced.groupBy("lecture_id").agg(F.sum("cost").alias("cost"), F.sum("seconds").alias("seconds"))
    hours = F.sum("duration_s") / 3600
    return spent.join(lectures, "lecture_id").agg((F.sum("cost") / hours).alias("cost_per_hour"), (F.sum("seconds") / hours).alias("seconds_per_hour"))


def feedback_share(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy().agg(F.count("*").alias("ratings"), F.sum((F.col("rating") == "up").cast("long")).alias("up"), F.avg((F.col("rating") == "up").cast("double")).alias("helpful"))
