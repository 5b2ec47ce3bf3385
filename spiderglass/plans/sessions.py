"""Sessions: the list with counts, modes and states, and changes to the small session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_total(config: Column) -> Column:
    """How many urls a session's configuration lists; null for a spider."""
    nested = F.json_array_length(F.get_json_object(config, "$.inputs.urls"))
    flat = F.json_array_length(F.get_json_object(config, "$.urls"))
    return F.coalesce(F.when(nested > 0, nested), F.when(flat > 0, flat)).cast("long")


def with_counts(sessions: DataFrame, results: DataFrame, top: int = 50) -> DataFrame:
    """The newest sessions with their numbers of results (0 where there are none)."""
    n = results.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("result_count"))
    return sessions.join(n, "id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0).cast("long"))).orderBy(F.desc("started_at"), F.desc("id")).limit(top)


def meta(listed: DataFrame) -> DataFrame:
    """Mode, state and progress label of listed sessions."""
    total = list_total(F.col("config_json"))
    state = F.when(F.col("completed_at").isNull(), "in progress").when(F.col("total").isNotNull() & (F.col("result_count") < F.col("total")), "stopped").otherwise("complete")
    number = lambda c: F.regexp_replace(F.format_number(c, 0), "^$", "0")
    label = F.when(F.col("total").isNotNull(), F.concat(number("result_count"), F.lit(" / "), number("total"), F.lit(" URLs"))).otherwise(F.concat(number("result_count"), F.lit(" URLs")))
    return listed.withColumn("total", total).select("id", F.when(F.col("total").isNotNull(), "list").otherwise("spider").alias("mode"), F.col("total").alias("list_total"), state.alias("state"), label.alias("progress"))


def partial(listed: DataFrame) -> DataFrame:
    """Whether a reopened session is incomplete."""
    total = list_total(F.col("config_json"))
    return listed.withColumn("total", total).select("id", F.when(F.col("total").isNotNull(), F.col("result_count") < F.col("total")).otherwise(F.col("completed_at").isNull() & (F.col("result_count") > 0)).alias("partial"))


def completion(rows: DataFrame) -> DataFrame:
    """How a crawl ended, from row_count, error_count, list_total, interrupted and retryable_count."""
    gap = (F.col("list_total") > 0) & (F.col("row_count") < F.col("list_total"))
    return rows.select("*", (F.col("interrupted") | gap | (F.col("retryable_count") > 0)).alias("is_stopped"), (F.col("error_count") > 0).alias("had_failures"), gap.alias("incomplete_list"))


def hero(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.when(F.col("crawling"), "CRAWLING").when(F.col("stopped"), "STOPPED").when(F.col("total") > 0, "COMPLETE").otherwise("READY").alias("hero"))


# ---- changes: each gives the new table -------------------------------------------------------


def created(sessions: DataFrame, start_url: str, config: str = "{}", started_at=None) -> DataFrame:
    """One more session with the next id."""
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = last.select((F.col("last") + 1).alias("id"), F.lit(start_url).alias("start_url"), (F.lit(started_at).cast("timestamp") if started_at else F.current_timestamp()).alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(config).alias("config_json"))
    return sessions.unionByName(new)


def changed(sessions: DataFrame, session_id: int, **columns) -> DataFrame:
    """A session with other values: completed_at to complete it, config_json to configure it."""
    return sessions.withColumns({c: F.when(F.col("id") == session_id, F.lit(v).cast(sessions.schema[c].dataType)).otherwise(F.col(c)) for c, v in columns.items()})


def deleted(session_id: int, sessions: DataFrame, results: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a session; its frontier goes too."""
    keep = F.col("session_id") != session_id
    return sessions.where(F.col("id") != session_id), results.where(keep), frontier.where(keep)
