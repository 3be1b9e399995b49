"""What providers told about their limits, kept as rows: quotas, calls of the day, and the pace that was learned.

A log of responses only grows; what counts is aggregated when it is read, partly before rows are moved, so that a
provider that has most of the rows is no one task.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .store import exists, scratch

# Headers and sentences in which limits are told.
REQUESTS, TOKENS = "x-ratelimit-{}-requests", "x-ratelimit-{}-tokens"
DAILY = r"(?i)on (tokens|requests) per day \((TPD|RPD)\):\s*Limit (\d+),\s*Used (\d+)"
METRIC = r"(?is)metric:\s*([\w./-]+).*?limit:\s*(\d+)"
# Fixed value: what a run without refusals leaves of the pace.
EASED = 0.85


def quota(responses: DataFrame) -> DataFrame:
    """What is known of each provider from its responses (provider, model, at, status, headers, body), one row each.

    limit_requests, remaining_requests, limit_tokens, remaining_tokens, reset_requests_seconds and
    reset_tokens_seconds are each from the last response that told it, observed_at is the last that told a limit of
    requests; remaining_requests is the limit where a response with a limit doesn't say. daily_metric, daily_value,
    daily_used and daily_at are from the last refusal (status 429) that named a limit a day, limit_metric, limit_value
    and limit_at from the last that named another one. calls counts all rows, calls_today those of the provider's last
    day in the session's time zone. headers is a map with names in lower case; a response without them, or with ones that aren't numbers,
    tells nothing. Of responses at one time the larger value counts. A null at comes before all others.
    """
    tells = F.col("headers")[REQUESTS.format("limit")].try_cast("long").isNotNull()
    number = lambda name: F.when(tells, F.col("headers")[name].try_cast("long"))
    seconds = lambda name: F.when(tells, T.duration_seconds(F.trim(F.col("headers")[name])))
    body = F.coalesce("body", F.lit(""))
    refused = F.col("status") == 429
    daily, named = refused & body.rlike(DAILY), refused & ~body.rlike(DAILY) & body.rlike(METRIC)
    part = lambda pattern, i: F.regexp_extract(body, pattern, i)
    facts = {
        "limit_requests": number(REQUESTS.format("limit")),
        "remaining_requests": F.when(tells, F.coalesce(number(REQUESTS.format("remaining")), number(REQUESTS.format("limit")))),
        "limit_tokens": number(TOKENS.format("limit")), "remaining_tokens": number(TOKENS.format("remaining")),
        "reset_requests_seconds": seconds(REQUESTS.format("reset")), "reset_tokens_seconds": seconds(TOKENS.format("reset")),
        "model": F.col("model"),
    }
    told = F.struct(F.concat(F.lower(part(DAILY, 1)), F.lit(" per day ("), F.upper(part(DAILY, 2)), F.lit(")")).alias("metric"), part(DAILY, 3).try_cast("long").alias("value"), part(DAILY, 4).try_cast("long").alias("used"))
    other = F.struct(part(METRIC, 1).alias("metric"), part(METRIC, 2).try_cast("long").alias("value"))
    rows = responses.select("provider", "at", F.to_date("at").alias("day"), *[v.alias(k) for k, v in facts.items()], tells.alias("tells"), F.when(daily, told).alias("daily"), F.when(named, other).alias("limit"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))
    days = rows.groupBy("provider", "day").agg(*[last(c).alias(c) for c in (*facts, "daily", "limit")], F.max(F.when(F.col("tells"), F.col("at"))).alias("observed_at"), F.count("*").alias("n"))
    one = days.groupBy("provider").agg(
        *[F.max(c).alias(c) for c in (*facts, "daily", "limit", "observed_at")], F.sum("n").alias("calls"), F.max(F.struct("day", "n"))["n"].alias("calls_today")
    )
    out = [F.col(c)["v"].alias(c) for c in ("model", *list(facts)[:-1])]
    far = [F.col("daily.v.metric").alias("daily_metric"), F.col("daily.v.value").alias("daily_value"), F.col("daily.v.used").alias("daily_used"), F.col("daily.at").alias("daily_at")]
    near = [F.col("limit.v.metric").alias("limit_metric"), F.col("limit.v.value").alias("limit_value"), F.col("limit.at").alias("limit_at")]
    return one.select("provider", *out, "observed_at", *far, *near, "calls", "calls_today")


def learned_pace(runs: DataFrame) -> DataFrame:
    """(provider, pace) in seconds, from runs (provider, run, hit_limit, pace, default_pace).

    A run that was refused leaves the pace that it ended with; each run after it that wasn't lowers that to 0.85 of
    it, down to the provider's default (the largest, if runs differ). A provider that was never refused keeps its
    default. A null hit_limit is no refusal; runs of one number count each, refused ones first.
    """
    hit = F.coalesce("hit_limit", F.lit(False))
    last = runs.filter(hit).groupBy("provider").agg(F.max(F.struct("run", "pace")).alias("last")).withColumnRenamed("provider", "_p")
    joined = runs.join(last, F.col("provider").eqNullSafe(F.col("_p")), "left")
    after = ~hit & (F.col("run") >= F.col("last.run"))
    agg = joined.groupBy("provider").agg(F.max("last.pace").alias("p"), F.count_if(after).alias("k"), F.max("default_pace").alias("d"))
    eased = F.greatest("d", F.col("p") * F.pow(F.lit(EASED), F.col("k")))
    return agg.select("provider", F.when(F.col("p").isNull(), F.col("d")).when(F.col("k") == 0, F.col("p")).otherwise(eased).alias("pace"))


class Paces:
    """Seconds between requests, learned from run to run: rows (provider, run, hit_limit, pace, default_pace) in a folder.

    Rows are only added, one a run; a run's number is the driver's clock in nanoseconds.
    """

    SCHEMA = "provider string, run long, hit_limit boolean, pace double, default_pace double"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "paces")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def start(self, provider: str, default: float) -> float:
        """The pace that a provider's next run begins with, never below `default` unless it was just learned so."""
        mine = self.rows().filter(F.col("provider") == provider).withColumn("default_pace", F.lit(default))
        found = learned_pace(mine).first()  # one row at most
        return found.pace if found else default

    def record(self, provider: str, hit_limit: bool, pace: float, default: float) -> None:
        row = [(provider, time.time_ns(), hit_limit, float(pace), float(default))]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def level(used, total):
    """green below 0.6 of a quota, yellow below 0.85, red from there on; null where there is no quota."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), used / F.nullif(total, F.lit(0))))
    return F.when(total > 0, F.when(share < 0.6, "green").when(share < 0.85, "yellow").otherwise("red"))


def bar(used, total, width: int = 28):
    """A quota as blocks with its figures, "n/a" where there is none."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), used / F.nullif(total, F.lit(0))))
    filled = F.bround(share * width).cast("int")
    blocks = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
    figures = F.concat(F.lit(" "), F.format_number(used, 0), F.lit("/"), F.format_number(total, 0), F.lit(" ("), F.bround(share * 100).cast("int").cast("string"), F.lit("%)"))
    return F.when(total > 0, F.concat(blocks, figures)).otherwise("n/a")
