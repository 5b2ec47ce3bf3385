"""Health kept up to date: signed changes of each batch, folded into sums and a counted set of response times.

An upsert takes a row out and puts another in, so all of `aggregates.health` but the average and the maximum are sums
of +1 and -1. The average is two more sums. A maximum can't be taken back from, so response times are kept with how
often each is there; the largest that is still there is the maximum. The frontier grows by urls that are new and not
crawled, and shrinks by crawled urls that were known.

A batch appends its change, one row a session and one a (session, response time); it reads the batch and the rows
that it replaces, and nothing else. A batch of one number replaces itself, so one that is done again counts once.
`fold` sums the changes of all batches into one; until that is written whole, readers take the batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .filters import is_2xx, text_of
from .ingest import content_page

_USED = ["session_id", "status", "error", "redirect_url", "is_indexable", "is_noindex", "is_nofollow", "resource_type", "h1", "title", "response_time"]
_SUMS = "session_id long, total long, status_2xx long, status_3xx long, status_4xx long, status_5xx long, status_other long, errors long, redirects long, indexable long, noindex long, nofollow long, empty_h1 long, empty_title long, sec_html long, sec_missing_hsts long, sec_missing_csp long, sec_missing_xframe long, time_sum long, time_n long, frontier long"
_TIMES = "session_id long, response_time long, n long"


def counted() -> dict[str, Column]:
    """The conditions whose rows health counts."""
    status, missing = F.col("status"), lambda k: ~F.col(f"security.{k}")
    return {
        "total": F.lit(True), "status_2xx": is_2xx(), **{f"status_{k}xx": (status >= k * 100) & (status < (k + 1) * 100) for k in (3, 4, 5)}, "status_other": (status < 200) | (status >= 600),
        "errors": text_of("error") != "", "redirects": text_of("redirect_url") != "", "indexable": F.col("is_indexable"), "noindex": F.col("is_noindex"), "nofollow": F.col("is_nofollow"),
        "empty_h1": content_page() & (text_of("h1") == ""), "empty_title": content_page() & (text_of("title") == ""),
        "sec_html": F.col("security.hsts").isNotNull(), "sec_missing_hsts": missing("hsts"), "sec_missing_csp": missing("csp"), "sec_missing_xframe": missing("xFrameOptions"),
    }


def frontier_change(seen: DataFrame | None, crawled: DataFrame | None, discovered: DataFrame, fetched: DataFrame) -> DataFrame:
    """(session_id, n): by how much a batch (urls discovered and fetched) changes the number of urls seen and not crawled,
    where seen and crawled are those before; they may be cut down to the batch's keys."""
    key = ["session_id", "url"]
    new, done = discovered.select(*key).distinct(), fetched.select(*key).distinct()
    fresh = new.join(done, key, "left_anti")
    if crawled is not None:
        fresh, done = fresh.join(crawled.select(*key), key, "left_anti"), done.join(crawled.select(*key), key, "left_anti")
    if seen is not None:
        fresh, done = fresh.join(seen.select(*key), key, "left_anti"), done.join(seen.select(*key), key, "left_semi")
    else:
        done = done.where(F.lit(False))
    each = fresh.select("session_id", F.lit(1).cast("long").alias("n")).union(done.select("session_id", F.lit(-1).cast("long")))
    return each.groupBy("session_id").agg(F.sum("n").alias("n"))


class HealthView:
    """The health of each session in a folder, changed batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def apply(self, batch: int, new: DataFrame, old: DataFrame | None = None, frontier: DataFrame | None = None) -> None:
        """new: the rows that batch (from 0) puts in, one a key; old: the rows they replace; frontier: its `frontier_change`."""
        side = lambda rows, sign: rows.select(*_USED, F.col("seo.securityHeaders").alias("security"), F.lit(sign).cast("long").alias("sign"))
        rows = side(new, 1) if old is None else side(new, 1).unionByName(side(old, -1))
        timed = is_2xx() & F.col("response_time").isNotNull()
        of = lambda condition, value: F.sum(F.when(condition, value).otherwise(0)).cast("long")
        sums = rows.groupBy("session_id").agg(*[of(c, F.col("sign")).alias(n) for n, c in counted().items()], of(timed, F.col("sign") * F.col("response_time")).alias("time_sum"), of(timed, F.col("sign")).alias("time_n"))
        if frontier is None:
            sums = sums.withColumn("frontier", F.lit(0).cast("long"))
        else:
            both = sums.join(frontier.withColumnRenamed("n", "frontier"), "session_id", "full_outer")
            sums = both.select("session_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in both.columns if c != "session_id"])
        times = rows.where(timed).groupBy("session_id", "response_time").agg(F.sum("sign").alias("n")).where("n <> 0")
        for name, made in (("times", times), ("sums", sums)):
            made.write.mode("overwrite").parquet(f"{self.path}/{name}/batch-{batch:012d}")

    def _there(self) -> tuple[str | None, list[str]]:
        """The newest whole fold, and the whole batches after it."""
        both = lambda n: all(files.whole(self.spark, f"{self.path}/{t}/{n}") for t in ("times", "sums"))
        found = files.names(self.spark, f"{self.path}/sums")
        fold = max((n for n in found if n.startswith("fold-") and both(n)), default=None)
        last = int(fold[5:]) if fold else -1
        return fold, [n for n in found if n.startswith("batch-") and int(n[6:]) > last and both(n)]

    def _read(self, name: str, schema: str) -> DataFrame:
        fold, batches = self._there()
        parts = [f"{self.path}/{name}/{n}" for n in ([fold] if fold else []) + batches]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*parts)
        keys = [c for c in rows.columns if c in ("session_id", "response_time")]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    def read(self) -> DataFrame:
        """The row of `aggregates.health` of each session that has results."""
        times = self._read("times", _TIMES).where("n > 0").groupBy("session_id").agg(F.max("response_time").alias("most"))
        sums = self._read("sums", _SUMS).where("total > 0").join(times, "session_id", "left")
        average = F.when(F.col("time_n") > 0, F.col("time_sum") / F.col("time_n")).otherwise(F.lit(0.0)).alias("avg_response_time")
        names = list(counted())
        return sums.select("session_id", *names[:13], average, F.coalesce("most", F.lit(0).cast("long")).alias("max_response_time"), *names[13:], "frontier")

    def fold(self) -> None:
        """One change instead of many; the folded ones go afterwards."""
        fold, batches = self._there()
        if not batches:
            return
        name = f"fold-{batches[-1][6:]}"
        for table, schema in (("times", _TIMES), ("sums", _SUMS)):
            rows = self._read(table, schema)
            (rows.where("n <> 0") if table == "times" else rows).write.mode("overwrite").parquet(f"{self.path}/{table}/{name}")
        for table in ("sums", "times"):
            for n in [*batches, *([fold] if fold else [])]:
                files.remove(self.spark, f"{self.path}/{table}/{n}")
