"""Pages of sorted rows by order statistics: no page sorts or gathers the rows before it.

`Ordered.write` range-partitions the rows by the sort column and id once and writes each partition as a sorted run.
How many rows each run holds is a table of one row a run, which the driver sums up. A page is then a range of places
in one or two runs: these are read, and in them the rows whose places the page names.

A value that very many rows share is split among runs by id, so runs stay even. Nulls come first in ascending and
last in descending order; ties are in order of id either way; a page beyond the end is empty.
"""

from __future__ import annotations

import bisect
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import shared_folder
from .grid import SORTABLE


class Ordered:
    """Rows in the order of `grid.sort_results`, as runs in a folder."""

    def __init__(self, runs: DataFrame):
        self.runs = runs
        held = sorted(map(tuple, runs.groupBy("_run").agg(F.count("*").alias("n")).collect()))  # one row a run
        self.numbers = [run for run, _ in held]
        self.before = [0, *accumulate(n for _, n in held)]

    @classmethod
    def write(cls, results: DataFrame, column: str | None = None, direction: str = "asc", path: str | None = None, runs: int | None = None) -> Ordered:
        """Runs of results by a sortable column, then id; by id alone for any other column. runs: how many, else as Spark finds fit."""
        spark = results.sparkSession
        path = path or f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
        by = [F.col("id").asc()]
        if column in SORTABLE.values() and column != "id":
            by.insert(0, F.col(column).desc() if (direction or "").lower() == "desc" else F.col(column).asc())
        elif column == "id" and (direction or "").lower() == "desc":
            by = [F.col("id").desc()]
        dealt = results.repartitionByRange(runs, *by) if runs else results.repartitionByRange(*by)
        near = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place in the partition
        dealt.sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_run"), near.alias("_nth")).write.partitionBy("_run").parquet(path)
        places = [T.StructField("_nth", T.LongType()), T.StructField("_run", T.IntegerType())]
        return cls(spark.read.schema(T.StructType([*results.schema.fields, *places])).parquet(path))

    @property
    def total(self) -> int:
        return self.before[-1]

    def between(self, first: int, end: int) -> DataFrame:
        """The rows at places first to end (exclusive, from 0), with their `place`."""
        first, end = max(0, first), min(end, self.total)
        held = []
        if first < end:
            held = range(bisect.bisect_right(self.before, first) - 1, bisect.bisect_left(self.before, end))
        inside: Column = F.lit(False)
        place: Column = F.lit(None).cast("long")
        for k in held:
            run = F.col("_run") == self.numbers[k]
            inside = inside | (run & (F.col("_nth") >= first - self.before[k]) & (F.col("_nth") < end - self.before[k]))
            place = F.when(run, F.col("_nth") + self.before[k]).otherwise(place)
        # The runs are named once more, so that the others are not even listed.
        rows = self.runs.where(F.col("_run").isin([self.numbers[k] for k in held])).where(inside)
        return rows.select(*[c for c in self.runs.columns if c not in ("_run", "_nth")], place.alias("place"))

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 0) in order."""
        return self.between(number * size, (number + 1) * size).orderBy("place").drop("place")

    def places(self) -> DataFrame:
        """All rows with their `place`."""
        starts = self.runs.sparkSession.createDataFrame(list(zip(self.numbers, self.before, strict=False)) or [(0, 0)], "_run int, _start long")
        return self.runs.join(starts, "_run").withColumn("place", F.col("_nth") + F.col("_start")).drop("_run", "_nth", "_start")

    def page_starts(self, size: int) -> DataFrame:
        """(page, n, first_id, last_id) of every page of so many rows."""
        ends = F.struct("place", "id")
        return self.places().groupBy(F.floor(F.col("place") / size).alias("page")).agg(F.count("*").alias("n"), F.min(ends)["id"].alias("first_id"), F.max(ends)["id"].alias("last_id"))
