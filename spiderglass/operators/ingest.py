"""Ingest: coercion, blanking of non-content rows, last-wins upsert, frontier maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def content_page() -> Column:
    """CONTENT_PAGE: an HTML row with a 2xx status."""
    return (F.col("resource_type") == "HTML") & (F.col("status") >= 200) & (F.col("status") < 300)


def blank_non_content(results: DataFrame) -> DataFrame:
    """Rows that are no content page lose the fields that feed content metrics; columns not there are not made."""
    keep = F.coalesce(content_page(), F.lit(False))
    put = {c: F.when(keep, F.col(c)).otherwise(F.lit("")) for c in ("title", "h1", "h2", "meta_description", "canonical") if c in results.columns}
    if "word_count" in results.columns:
        put["word_count"] = F.when(keep, F.col("word_count")).otherwise(F.lit(0).cast("long"))
    if "seo" in results.columns:
        there = set(results.schema["seo"].dataType.names)
        blanks = {"contentHash": F.lit(""), **{k: F.lit(0).cast("long") for k in ("h1Count", "h2Count", "imagesMissingAlt")}}
        for k in ("structuredDataTypes", "hreflang", "missingAltImages", "securityHeaders"):
            if k in there:
                kind = results.schema["seo"].dataType[k].dataType
                blanks[k] = F.lit(None).cast(kind) if k == "securityHeaders" else F.array().cast(kind)
        seo = F.col("seo")
        for k, blank in blanks.items():
            if k in there:
                seo = seo.withField(k, F.when(keep, F.col(f"seo.{k}")).otherwise(blank))
        put["seo"] = seo
    return results.withColumns(put)


def last_wins(results: DataFrame, order: str = "seq", key: tuple[str, ...] = ("session_id", "url")) -> DataFrame:
    """The newest row of each key. Ranked within the key, so only equal keys meet."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """stored without the keys of batch (anti join), and the newest row of each of batch's keys."""
    newest = last_wins(batch, order)
    return stored.join(newest.select("session_id", "url"), ["session_id", "url"], "left_anti").unionByName(newest, allowMissingColumns=True)


def frontier(discovered: DataFrame, crawled: DataFrame) -> DataFrame:
    """Discovered urls, once each, that their session has not crawled."""
    return discovered.select("session_id", "url").dropDuplicates().join(crawled.select("session_id", "url"), ["session_id", "url"], "left_anti")


def coerce(records: DataFrame) -> DataFrame:
    """Parsed JSON records in the result schema: wrong or missing strings as "", numbers as 0, flags by truth."""
    cols = []
    for name, kind, key in schema.PROMOTED:
        if name in ("id", "session_id"):
            cols.append((F.col(key) if key in records.columns else F.col(name) if name in records.columns else F.lit(None)).cast("long").alias(name))
        elif key not in records.columns:
            cols.append({"string": F.lit(None if name == "error" else ""), "bigint": F.lit(0), "boolean": F.lit(name == "is_indexable")}[kind.simpleString()].cast(kind).alias(name))
        else:
            c = F.col(key).cast(kind)
            cols.append((c if name == "error" else F.coalesce(c, {"string": F.lit(""), "bigint": F.lit(0), "boolean": F.lit(False)}[kind.simpleString()].cast(kind))).alias(name))
    return records.select(*cols, pack_seo(records).alias("seo"))


def pack_seo(records: DataFrame) -> Column:
    """The overflow struct with every key present and defaults for what is missing."""
    fields = []
    for f in schema.SEO.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            empty = F.array().cast(f.dataType)
        elif kind.startswith("map"):
            empty = F.create_map().cast(f.dataType)
        else:
            empty = {"string": F.lit(""), "bigint": F.lit(0), "boolean": F.lit(False)}.get(kind, F.lit(None)).cast(f.dataType)
        fields.append((F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in records.columns else empty).alias(f.name))
    return F.struct(*fields)
