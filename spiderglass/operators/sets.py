"""Set operations on urls: resume seeds, exclusions, retries, recrawl queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARKED = "host_blocked_by_detector"


def parked():
    return F.lower(F.coalesce("error", F.lit(""))).startswith(PARKED)


def skippable(results: DataFrame) -> DataFrame:
    """Urls that a resumed crawl need not fetch again: all that were not parked."""
    return results.where(~parked()).select("session_id", "url")


def retryable(results: DataFrame) -> DataFrame:
    return results.where(parked()).select("session_id", "url").distinct()


def resume_seeds(frontier: DataFrame, retry: DataFrame) -> DataFrame:
    return frontier.select("session_id", "url").union(retry.select("session_id", "url")).distinct()


def exclude(urls: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        urls = urls.join(other.select("session_id", "url").distinct(), ["session_id", "url"], "left_anti")
    return urls


def recrawl_drain(queue: DataFrame, results: DataFrame) -> DataFrame:
    """What of a recrawl queue has not recovered: no row with a status from 200 to 399."""
    recovered = results.where("status >= 200 AND status < 400")
    return exclude(queue, recovered)


def sitemap_union(*found: DataFrame, cap: int = 50_000) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct().limit(cap)


def session_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Urls of two sessions: added, removed, changed (other status or title) or same. An extra of ours."""
    side = lambda df, s: df.select("url", F.col("status").alias(f"{s}_status"), F.coalesce("title", F.lit("")).alias(f"{s}_title"))
    both = side(old, "old").join(side(new, "new"), "url", "full_outer")
    change = F.when(F.col("old_status").isNull(), "added").when(F.col("new_status").isNull(), "removed").when((F.col("old_status") != F.col("new_status")) | (F.col("old_title") != F.col("new_title")), "changed").otherwise("same")
    return both.select("url", "old_status", "new_status", change.alias("change"))
