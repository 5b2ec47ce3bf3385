"""Flat export: the columns of a session are discovered, rows flattened to text cells, lists exploded."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from .graph import shared_folder

# The export's core columns in order, each with the JSON key it shows ("" is computed).
CORE = """url=url status=status content_type=contentType resource_type=resourceType size=size response_time=responseTime crawl_depth=crawlDepth in_sitemap=inSitemap error=error id=id
blocked_by_robots=blockedByRobots meta_robots=metaRobots meta_googlebot=metaGooglebot x_robots_tag=xRobotsTag canonical=canonical canonical_is_self= redirect_url=redirectUrl title=title
title_length= h1=h1 h1_count=h1Count h2=h2 h2_count=h2Count meta_description=metaDescription meta_description_length= word_count=wordCount content_hash=contentHash internal_links=internalLinks
external_links=externalLinks image_count=imageCount images_missing_alt=imagesMissingAlt missing_alt_images=missingAltImages og_title=ogTitle og_description=ogDescription og_type=ogType og_url=ogUrl
og_image=ogImage og_image_width=ogImageWidth og_image_height=ogImageHeight og_image_width_real=ogImageWidthReal og_image_height_real=ogImageHeightReal og_image_file_size=ogImageFileSize
date_published=datePublished date_modified=dateModified date_published_time=datePublishedTime date_modified_time=dateModifiedTime server_header=serverHeader structured_data_count=
structured_data_types=structuredDataTypes perf_ttfb= perf_dom_content_loaded= perf_load_time= perf_fcp= perf_lcp= perf_cls= outlink_count= hreflang_count= failed_request_count=
console_error_count= js_error_count= js_errors=jsErrors"""
CORE_COLUMNS = [tuple(x.split("=")) for x in CORE.split()]
PERF = {"perf_ttfb": "ttfb", "perf_dom_content_loaded": "domContentLoaded", "perf_load_time": "loadTime", "perf_fcp": "fcp", "perf_lcp": "lcp", "perf_cls": "cls"}
COUNTS = {"structured_data_count": "structuredDataTypes", "outlink_count": "outlinks", "hreflang_count": "hreflang", "failed_request_count": "failedRequests", "console_error_count": "consoleErrors", "js_error_count": "jsErrors"}
BOM = "﻿"


@dataclass(frozen=True)
class ExportSchema:
    headers: tuple[str, ...] = ()
    metas: tuple[str, ...] = ()
    hreflang: int = 0
    redirects: int = 0

    def columns(self) -> list[str]:
        out = [name for name, _ in CORE_COLUMNS] + [f"redirect_{i}" for i in range(1, self.redirects + 1)]
        out += [f"hreflang_{i}_{part}" for i in range(1, self.hreflang + 1) for part in ("lang", "url")]
        return out + [f"header:{k}" for k in self.headers] + [f"meta:{k}" for k in self.metas]


def meta_key(tag: Column) -> Column:
    """The name of a meta tag, else its property, in lower case."""
    return F.lower(F.coalesce(F.nullif(tag["name"], F.lit("")), F.nullif(tag["property"], F.lit(""))))


def discovered(results: DataFrame) -> DataFrame:
    """One row (headers, metas, hreflang, redirects): names over all rows, and the longest lists."""
    names = results.select(F.explode(F.concat(
        F.transform(F.coalesce(F.map_keys("seo.responseHeaders"), F.array().cast("array<string>")), lambda k: F.struct(F.lit("header").alias("kind"), F.lower(k).alias("name"))),
        F.transform(F.coalesce("seo.metaTags", F.array().cast("array<struct<name:string,property:string,content:string>>")), lambda t: F.struct(F.lit("meta").alias("kind"), meta_key(t).alias("name"))),
    )).alias("x")).select("x.*").where("name is not null").distinct()
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    wide = results.agg(F.coalesce(F.max(F.size("seo.hreflang")), F.lit(0)).alias("hreflang"), F.coalesce(F.max(F.size("seo.redirectChain")), F.lit(0)).alias("redirects"))
    return names.agg(of("header").alias("headers"), of("meta").alias("metas")).join(wide)


def discover_schema(results: DataFrame) -> ExportSchema:
    """Names and widths are few; they come to the driver to make the select list."""
    r = discovered(results).first()
    return ExportSchema(tuple(r.headers), tuple(r.metas), max(r.hreflang, 0), max(r.redirects, 0))


def _values(results: DataFrame) -> dict[str, tuple[Column, str]]:
    """Each JSON key's column and kind."""
    from .. import schema

    out = {key: (F.col(name), kind.simpleString()) for name, kind, key in schema.PROMOTED}
    out |= {f.name: (F.col(f"seo.{f.name}"), f.dataType.simpleString()) for f in schema.SEO.fields}
    return out


def _named(k: str, name):
    return lambda x: name(x) == k


def flatten(results: DataFrame, found: ExportSchema) -> DataFrame:
    """One row of text cells a url."""
    made, values = [], _values(results)
    cell = lambda key: text.cell(*values[key])
    for name, key in CORE_COLUMNS:
        if name in PERF:
            c = F.coalesce(F.col(f"seo.perf.{PERF[name]}").cast("string"), F.lit(""))
        elif name in COUNTS:
            c = F.greatest(F.coalesce(F.size(f"seo.{COUNTS[name]}"), F.lit(0)), F.lit(0)).cast("string")
        elif name == "canonical_is_self":
            c = urls.is_self(cell("canonical"), cell("url"))
        elif name in ("title_length", "meta_description_length"):
            c = F.length(cell("title" if name == "title_length" else "metaDescription")).cast("string")
        elif values[key][1] == "array<string>":
            c = F.coalesce(F.array_join(F.transform(values[key][0], lambda x: text.cell(x)), " | "), F.lit(""))
        elif key in ("status", "size", "responseTime", "wordCount", "internalLinks", "externalLinks", "ogImageWidth", "ogImageHeight", "id"):
            c = F.coalesce(values[key][0], F.lit(0)).cast("string")
        else:
            c = cell(key)
        made.append(c.alias(name))
    made += [text.cell(F.get("seo.redirectChain", F.lit(i))).alias(f"redirect_{i + 1}") for i in range(found.redirects)]
    for i in range(found.hreflang):
        entry = F.get("seo.hreflang", F.lit(i))
        made += [text.cell(entry["lang"]).alias(f"hreflang_{i + 1}_lang"), text.cell(entry["href"]).alias(f"hreflang_{i + 1}_url")]
    entries = F.map_entries("seo.responseHeaders")
    for k in found.headers:
        made.append(text.cell(F.get(F.filter(entries, _named(k, lambda e: F.lower(e["key"]))), F.lit(0))["value"]).alias(f"header:{k}"))
    for k in found.metas:
        cells = F.transform(F.filter("seo.metaTags", _named(k, meta_key)), lambda t: text.cell(t["content"]))
        made.append(F.coalesce(F.array_join(F.filter(cells, lambda x: x != ""), " | "), F.lit("")).alias(f"meta:{k}"))
    return results.select(*made)


def outlinks(results: DataFrame) -> DataFrame:
    rows = results.select(F.col("url").alias("source_url"), F.explode("seo.outlinks").alias("target_url"))
    return rows.withColumn("link_scope", urls.link_scope(F.col("source_url"), F.col("target_url")))


def failed_requests(results: DataFrame) -> DataFrame:
    return results.select(F.col("url").alias("page_url"), F.explode("seo.failedRequests").alias("resource_url"))


def console(results: DataFrame) -> DataFrame:
    return results.select(F.col("url").alias("page_url"), F.explode("seo.consoleErrors").alias("message"))


CHILDREN = {"outlinks": outlinks, "failed_requests": failed_requests, "console": console}


def _one_file(df: DataFrame, path: Path) -> int:
    """Executors write parts to the shared folder in parallel; the driver streams their lines (cells hold no line
    breaks) behind a BOM and one header, a part at a time."""
    spark = df.sparkSession
    parts = f"{shared_folder(spark)}/export/{uuid.uuid4().hex}"
    df.write.option("header", False).option("escape", '"').option("emptyValue", "").csv(parts)
    with path.open("w", encoding="utf-8", newline="") as out:
        out.write(BOM + ",".join(f'"{c}"' if "," in c or '"' in c else c for c in df.columns) + "\n")
        for line in spark.read.text(parts).toLocalIterator():
            out.write(line.value + "\n")
    return path.stat().st_size


def write_export(results: DataFrame, path: str) -> dict[str, int]:
    """path (main file) and path_<child>.csv beside it; all files appear at the end, or none. Bytes by file."""
    main = Path(path)
    work = main.parent / f".export-{uuid.uuid4().hex}"
    work.mkdir(parents=True)
    try:
        frames = {main.name: flatten(results, discover_schema(results))} | {f"{main.stem}_{k}{main.suffix}": f(results) for k, f in CHILDREN.items()}
        parts = {name: work / f"{name}.part" for name in frames}
        sizes = {name: _one_file(df, parts[name]) for name, df in frames.items()}
        for name, part in parts.items():
            os.replace(part, main.parent / name)
        return sizes
    finally:
        shutil.rmtree(work, ignore_errors=True)


def write_bundle(results: DataFrame, path: str, images: str | None = None) -> list[str]:
    """A zip of the four files (stored, 64-bit) and of the image folder under og-images/."""
    out = Path(path)
    work = out.parent / f".bundle-{uuid.uuid4().hex}"
    work.mkdir(parents=True)
    try:
        write_export(results, str(work / "crawl.csv"))
        part = work / "bundle.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for f in sorted(work.glob("*.csv")):
                z.write(f, f.name)
            for f in sorted(Path(images).rglob("*")) if images else ():
                if f.is_file():
                    z.write(f, f"og-images/{f.relative_to(images)}")
            names = z.namelist()
        os.replace(part, out)
        return names
    finally:
        shutil.rmtree(work, ignore_errors=True)


def write_table(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """At scale: the flat rows as a partitioned table, in parallel."""
    results.write.partitionBy("session_id").format(fmt).mode("overwrite").save(path)


def save_crawl(results: DataFrame, config: dict, path: str) -> None:
    """A small session as one JSON document."""
    import json

    from .grid import merge_overflow

    with Path(f"{path}.part").open("w") as out:
        out.write('{"version": 2, "config": ' + json.dumps(config) + ', "results": [')
        for i, line in enumerate(merge_overflow(results).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            out.write(("," if i else "") + line.j)
        out.write("]}")
    os.replace(f"{path}.part", path)
