"""Per-host sequences as window functions: rolling counts, runs, gaps, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WINDOW, RATE_WINDOW = 15, 100


def _host(order: str = "seq"):
    return Window.partitionBy("host").orderBy(order)


def block_count(rows: DataFrame, window: int = BLOCK_WINDOW) -> DataFrame:
    """Blocked responses among each host's last `window`."""
    return rows.withColumn("blocked_in_window", F.sum(F.col("blocked").cast("long")).over(_host().rowsBetween(1 - window, 0)))


def trailing_run(rows: DataFrame) -> DataFrame:
    """Length of the run of blocked responses that ends here."""
    at = F.row_number().over(_host())
    clear = F.last(F.when(~F.col("blocked"), F.col("_at")), ignorenulls=True).over(_host().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_at", at).withColumn("run", (F.col("_at") - F.coalesce(clear, F.lit(0))).cast("long")).drop("_at")


def block_rate(rows: DataFrame, window: int = RATE_WINDOW) -> DataFrame:
    w = _host().rowsBetween(1 - window, 0)
    return rows.withColumn("block_rate", F.sum(F.col("blocked").cast("double")).over(w) / F.count("*").over(w))


def _since(rows: DataFrame, reset: Column, counted: Column, name: str) -> DataFrame:
    """How many counted rows stand since the last reset."""
    island = F.sum(reset.cast("long")).over(_host().rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy("host", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_island", island).withColumn(name, F.sum(counted.cast("long")).over(w)).drop("_island")


def clean_streak(rows: DataFrame) -> DataFrame:
    """+1 on ok, 0 on blocked, unchanged on other."""
    return _since(rows, F.col("blocked"), F.col("classification") == "ok", "clean_streak")


def consecutive_403(rows: DataFrame) -> DataFrame:
    forbidden = F.col("classification") == "blocked-status:403"
    return _since(rows, ~forbidden, forbidden, "consecutive_403")


def gap_ms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gap_ms", F.col("ts_ms") - F.lag("ts_ms").over(_host()))


def last_n(rows: DataFrame, n: int, partition: str, order: str) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def pages_per_second(completions: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """At each completion of a host: completions in the last window over its length (1 s at least)."""
    w = Window.partitionBy("host").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    rate = F.count("*").over(w) / (F.greatest(F.col("ts_ms") - F.min("ts_ms").over(w), F.lit(1000)) / 1000)
    return completions.withColumn("pages_per_sec", F.round(rate, 2))


def eta(queue: Column, rate: Column) -> Column:
    """Time left as a label; a dash while it can't be told."""
    seconds = F.floor(queue / rate + 0.5).cast("long")
    minutes, hours = F.floor(queue / rate / 60).cast("long"), F.floor(queue / rate / 3600).cast("long")
    t = lambda c: c.cast("string")
    return (
        F.when((F.coalesce(queue, F.lit(0)) == 0) | (rate < 0.05), "—").when(queue / rate < 60, F.concat(F.lit("~"), t(seconds), F.lit("s")))
        .when(minutes < 60, F.concat(F.lit("~"), t(minutes), F.lit("m "), t(F.floor(F.pmod(queue / rate, F.lit(60.0)) + 0.5).cast("long")), F.lit("s")))
        .otherwise(F.concat(F.lit("~"), t(hours), F.lit("h "), t(minutes % 60), F.lit("m")))
    )


def sessionize(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, start, n): sessions of events with gaps under `minutes`, by Spark's session window."""
    w = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def paced(rows: DataFrame, delay_min: int, delay_max: int, seed: str = "pace", most: float = 8.0) -> DataFrame:
    """rows (host, seq, ts_ms, blocked) with what the rate limiter does to each request, which arrives at ts_ms:
    multiplier (doubled by each earlier block of the host, up to `most`), delay_ms (uniform between the bounds times
    the multiplier, drawn from a hash of seed, host and seq), start_ms and gap_ms since the host's last start.

    A request starts at its arrival, or its delay after the start before it: start(k) = max(arrival(k), start(k - 1) +
    delay(k)), which is D(k) + max over j <= k of arrival(j) - D(j) with D the running sum of delays; so no state is
    walked. Null arrivals start when the delay is over; an empty table gives no rows.
    """
    before = F.coalesce(F.sum(F.col("blocked").cast("long")).over(_host().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("multiplier", F.least(F.pow(F.lit(2.0), F.least(before, F.lit(30))), F.lit(most)))
    low, high = (F.floor(F.col("multiplier") * d + 0.5) for d in (delay_min, max(delay_min, delay_max)))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "host", F.col("seq").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = rows.withColumn("delay_ms", (low + F.floor(u * (high - low + 1))).cast("long"))
    whole = _host().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_d", F.sum("delay_ms").over(whole))
    rows = rows.withColumn("start_ms", F.col("_d") + F.max(F.col("ts_ms") - F.col("_d")).over(whole)).drop("_d")
    return rows.withColumn("gap_ms", F.coalesce(F.col("start_ms") - F.lag("start_ms").over(_host()), F.lit(0).cast("long")))


def multiplier(asked: Column) -> Column:
    """A multiplier set by hand, within the limiter's bounds."""
    return F.greatest(F.lit(0.05), F.least(F.lit(50.0), asked.cast("double")))
