"""A table that is written in batches and whose last row of a key counts: bucketed runs under a manifest.

Each batch is a run: the newest row of each of its keys, in buckets by a hash of the key. The manifest lists the runs
that are there; it is a small file of a new version each time, created only once all it names is written. So a reader
sees a batch or it doesn't, a batch that is done again after a crash is not there twice, and what a crash leaves behind
no manifest names.

`FAN` runs of a tier are merged into one of the next, last row first, so a table of n batches has about
FAN * log(n) runs, and each row is rewritten log(n) times. A key is in one bucket of each run: looking up the keys of
a batch reads their buckets, and a few keys are told by the Bloom filters in the files' footers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .ingest import last_wins

#: Runs of a tier that are merged, buckets of a run, keys that are looked up by value, manifests that a stream keeps for readers.
FAN, BUCKETS, FEW_KEYS, KEPT = 4, 16, 10, 2


class Runs:
    """Rows by key in a folder; order names the column whose greatest value is a key's last row."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("session_id", "url"), order: str = "seq", fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.fan, self.buckets = spark, path.rstrip("/"), key, order, fan, buckets
        # A Bloom filter is as large as a file's keys need, one of ten sizes up to the megabyte that Parquet sets aside for each.
        self.options = {"compression": "zstd", f"parquet.bloom.filter.enabled#{key[-1]}": "true", "parquet.bloom.filter.adaptive.enabled": "true", f"parquet.bloom.filter.candidates.number#{key[-1]}": "10"}

    def manifest(self) -> dict:
        """version, batch (the last one written), runs (name and tier, oldest first)."""
        for name in reversed(files.names(self.spark, f"{self.path}/manifest")):
            if name.endswith(".json"):
                try:
                    return json.loads(files.read(self.spark, f"{self.path}/manifest/{name}"))
                except ValueError:  # cut short by a crash
                    continue
        return {"version": 0, "batch": -1, "runs": []}

    def _publish(self, last: dict, **changed) -> None:
        taken = files.names(self.spark, f"{self.path}/manifest")
        version = max([last["version"], *(int(n.split(".")[0]) for n in taken if n.endswith(".json"))]) + 1
        files.create(self.spark, f"{self.path}/manifest/{version:012d}.json", json.dumps(last | changed | {"version": version}))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        # Ranked within bucket and key, so the rows are dealt out and sorted once, as they are written.
        newest = last_wins(rows.withColumn("bucket", self.bucket()), self.order, ("bucket", *self.key))
        newest.sortWithinPartitions("bucket", *self.key).write.options(**self.options).partitionBy("bucket").parquet(f"{self.path}/runs/{name}")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch; False if it, or a later one, is there already."""
        last = self.manifest()
        if batch <= last["batch"]:
            return False
        name = f"{batch:012d}-{uuid.uuid4().hex[:8]}"
        self._write(rows, name)
        full = bool(files.names(self.spark, f"{self.path}/runs/{name}", "bucket="))
        self._publish(last, batch=batch, runs=[*last["runs"], *([{"name": name, "tier": 0}] if full else [])])
        return True

    def compact(self) -> int:
        """Merges tiers that are full, lowest first; how many merges."""
        merges = 0
        while True:
            last = self.manifest()
            tiers = [r["tier"] for r in last["runs"]]
            full = next((t for t in sorted(set(tiers)) if tiers.count(t) >= self.fan), None)
            if full is None:
                return merges
            merged = [r for r in last["runs"] if r["tier"] == full]
            name = f"{merged[-1]['name'].split('-')[0]}-{uuid.uuid4().hex[:8]}"
            self._write(self._union(merged).drop("bucket"), name)
            others = [r for r in last["runs"] if r["tier"] != full]
            older = [r for r in others if r["tier"] > full]
            self._publish(last, runs=[*older, {"name": name, "tier": full + 1}, *[r for r in others if r["tier"] < full]])
            merges += 1

    def clean(self, keep: int = 1) -> list[str]:
        """Removes run folders that none of the last `keep` manifests names, and older manifests; for when no reader holds one."""
        last = self.manifest()
        there = [n for n in files.names(self.spark, f"{self.path}/manifest") if n.split(".")[0].isdigit()]
        old = [n for n in there if int(n.split(".")[0]) < last["version"]]
        held = old[max(0, len(old) - keep + 1) :]
        kept = {r["name"] for m in [last, *map(self._held, held)] for r in m["runs"]}
        gone = [n for n in files.names(self.spark, f"{self.path}/runs") if n not in kept]
        for n in gone:
            files.remove(self.spark, f"{self.path}/runs/{n}")
        for n in old:
            if n not in held:
                files.remove(self.spark, f"{self.path}/manifest/{n}")
        return gone

    def _held(self, name: str) -> dict:
        try:
            return json.loads(files.read(self.spark, f"{self.path}/manifest/{name}"))
        except ValueError:  # cut short by a crash
            return {"runs": []}

    def _union(self, runs: list[dict]) -> DataFrame:
        found = [self.spark.read.parquet(f"{self.path}/runs/{r['name']}") for r in runs]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        return rows

    def read(self) -> DataFrame | None:
        """The last row of each key; None before the first batch with rows."""
        runs = self.manifest()["runs"]
        return last_wins(self._union(runs), self.order, self.key).drop("bucket") if runs else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The last rows of these keys: their buckets are read, the others not."""
        runs = self.manifest()["runs"]
        if not runs:
            return None
        wanted = keys.select(*self.key).distinct()
        buckets = [r[0] for r in wanted.select(self.bucket()).distinct().collect()]  # at most the number of buckets
        rows = self._union(runs).where(F.col("bucket").isin(buckets))
        few = wanted.select(self.key[-1]).distinct().limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            rows = rows.where(F.col(self.key[-1]).isin([r[0] for r in few]))
        return last_wins(rows.join(wanted, list(self.key), "left_semi"), self.order, self.key).drop("bucket")
