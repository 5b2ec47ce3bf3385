"""Redirect chains from hop rows, by pointer doubling.

A hop leads from one url to another. Every url keeps the path it knows and the url at its end; a round appends the path
of that url, so a path doubles each round and a chain of n hops takes log2(n) joins. A path that comes back to a url it
has is a loop: it ends there. Rounds are written to the shared folder; the join is on (session, url), one row a url on the
side that is looked up, so urls to which very many others lead are split by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _keep
from .ingest import last_wins


def chains(hops: DataFrame) -> DataFrame:
    """(session_id, start_url, chain, hops, first_status, final_url, is_loop) of hops (session_id, seq, from_url, to_url, status).

    Of several hops from a url the last counts. A chain begins at a url that no other hop leads to; a loop also has a row
    that begins at its smallest url. A looping chain names each url once, its final url is the one it comes back to. A hop
    without an end is none."""
    hops = last_wins(hops.where("from_url is not null and to_url is not null"), "seq", ("session_id", "from_url"))
    hops = _keep(hops.select("session_id", F.col("from_url").alias("u"), F.col("to_url").alias("v"), "status"), "hops")
    known = hops.select("session_id", F.col("u").alias("end"), F.lit(True).alias("goes_on"))
    path = F.array("u", "v")
    state = hops.select("session_id", "u", path.alias("path"), F.col("v").alias("end"), (F.col("u") == F.col("v")).alias("loop"))
    state = state.join(known, ["session_id", "end"], "left").withColumn("open", F.coalesce("goes_on", F.lit(False)) & ~F.col("loop")).drop("goes_on")
    state = _keep(state, "chains")
    while not state.where("open").isEmpty():
        more = state.select("session_id", F.col("u").alias("end"), F.col("path").alias("more"), F.col("end").alias("_end"), F.col("open").alias("_open"))
        grown = state.where("open").join(more, ["session_id", "end"])
        both = F.concat("path", F.slice("more", 2, F.size("more")))
        grown = grown.select("session_id", "u", both.alias("path"), F.col("_end").alias("end"), "_open")
        # Up to where it comes back, that url included.
        distinct = F.size(F.array_distinct("path"))
        grown = grown.withColumn("loop", distinct < F.size("path")).withColumn("path", F.slice("path", F.lit(1), distinct + 1))
        grown = grown.select("session_id", F.when(F.col("loop"), F.element_at("path", -1)).otherwise(F.col("end")).alias("end"), "u", "path", "loop", (F.col("_open") & ~F.col("loop")).alias("open"))
        state = _keep(state.where("not open").unionByName(grown), "chains")
    led_to = hops.where("u <> v").select("session_id", F.col("v").alias("u"), F.lit(True).alias("led_to")).distinct()
    named = state.join(led_to, ["session_id", "u"], "left")
    on_loop = F.col("loop") & (F.col("end") == F.col("u")) & (F.array_min("path") == F.col("u"))
    named = named.where(F.col("led_to").isNull() | on_loop).join(hops.select("session_id", "u", "status"), ["session_id", "u"])
    chain = F.when(F.col("loop"), F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    return named.select("session_id", F.col("u").alias("start_url"), chain.alias("chain"), (F.size("path") - 1).cast("long").alias("hops"), F.col("status").alias("first_status"), F.col("end").alias("final_url"), F.col("loop").alias("is_loop"))
