"""Substring search without a full scan: an index of trigrams, kept as tables.

A text holds a needle only if it holds every trigram of it. So a batch of rows is indexed as three tables:

* `rows`, partitioned by `block`, the upper bits of the id: of the rows only the survivors' blocks are read, and
  there the needle is looked for itself, so the answer is that of the scan;
* `postings` (gram, field, id, block), partitioned by a hash of the gram and sorted by it: a search reads the
  partitions of a few grams, and there the row groups whose range covers them;
* `counts` (gram, field, n): how many rows hold a gram. The needle's rarest grams are read, the others are not.

A batch is there for readers once its counts are written, which come last. A search whose rarest grams stand in
more than WIDE of all rows scans them, for then the answer may be that large. Rows of a hot gram are dealt by
(gram, id), so no gram gathers in a task. Needles that are a table are answered together, by joins on the gram.

Texts are compared in lower case. Null fields hold nothing; needles of less than three characters scan; ids are
unique over all batches.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: Partitions of the postings by gram, bits of an id below its block, grams of a needle that are intersected.
PARTS, BLOCK_BITS, RARE = 64, 20, 3
#: Share of the rows beyond which they are scanned, and blocks beyond which they aren't named one by one.
WIDE, FEW_BLOCKS = 0.25, 2000
#: The field under which `counts` keeps the number of rows.
_ALL = ""
_POSTINGS, _COUNTS = "gram string, field string, id long, block long, part int", "gram string, field string, n long"


def grams_of(text: Column) -> Column:
    """The trigrams of a text, once each, in time in proportion to its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def holds(fields: list[str], needle: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(f)).contains(needle), F.lit(False)) for f in fields])


class TextIndex:
    """An index of string fields of rows that have a long `id`, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], parts: int = PARTS, block_bits: int = BLOCK_BITS):
        self.spark, self.path, self.fields, self.parts, self.block_bits = spark, path.rstrip("/"), fields, parts, block_bits

    def part_of(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def add(self, rows: DataFrame) -> TextIndex:
        """Indexes a batch of rows beside those that are there."""
        batch = uuid.uuid4().hex
        at = {name: f"{self.path}/{name}/batch={batch}" for name in ("rows", "postings", "counts")}
        block = F.shiftright("id", self.block_bits).alias("block")
        rows.select("*", block).repartitionByRange("block", "id").sortWithinPartitions("block", "id").write.partitionBy("block").parquet(at["rows"])
        if not files.names(self.spark, at["rows"], "block="):
            return self
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in self.fields])
        held = self.spark.read.parquet(at["rows"]).select("id", F.col("block").cast("long").alias("block"), F.explode(pairs).alias("f"))
        held = held.select("id", "block", "f.field", F.explode(grams_of(F.col("f.text"))).alias("gram")).withColumn("part", self.part_of(F.col("gram")))
        held.repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "field", "id").write.partitionBy("part").parquet(at["postings"])
        counts = self.spark.read.schema(_POSTINGS).parquet(at["postings"]).groupBy("gram", "field").agg(F.count("*").alias("n"))
        total = self.spark.read.parquet(at["rows"]).agg(F.lit("").alias("gram"), F.lit(_ALL).alias("field"), F.count("*").alias("n"))
        counts.union(total).write.parquet(at["counts"])
        return self

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        whole = [b for b in files.names(self.spark, f"{self.path}/counts") if files.whole(self.spark, f"{self.path}/counts/{b}")]
        if not whole:
            raise ValueError(f"nothing is indexed in {self.path}")
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (reader.schema(schema) if schema else reader).parquet(*[f"{self.path}/{name}/{b}" for b in whole])

    def rows(self) -> DataFrame:
        return self._read("rows").drop("batch", "block")

    def counts(self) -> DataFrame:
        """(gram, field, n): the rows whose field holds a gram."""
        return self._read("counts", _COUNTS).where(F.col("field") != _ALL).groupBy("gram", "field").agg(F.sum("n").alias("n"))

    def _size(self) -> int:
        return self._read("counts", _COUNTS).where(F.col("field") == _ALL).agg(F.sum("n")).first()[0]

    def chosen(self, needle: str) -> tuple[dict[str, list[str]], int]:
        """The rarest grams of a needle in each field that has all of them, and how many rows their postings can leave."""
        grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        found: dict[str, list[tuple[int, str]]] = {}
        for r in self.counts().where(F.col("gram").isin(grams)).collect():  # at most the needle's grams in each field
            found.setdefault(r.field, []).append((r.n, r.gram))
        whole = {f: sorted(rarest)[:RARE] for f, rarest in found.items() if len(rarest) == len(grams)}
        return {f: [g for _, g in rarest] for f, rarest in whole.items()}, sum(rarest[0][0] for rarest in whole.values())

    def candidates(self, grams: dict[str, list[str]]) -> DataFrame:
        """(id, block) of the rows of which some field has all the grams named for it."""
        names = sorted({g for some in grams.values() for g in some})
        parts = [r[0] for r in self.spark.createDataFrame([(g,) for g in names], "gram string").select(self.part_of(F.col("gram"))).distinct().collect()]
        bit = reduce(lambda c, x: c.when((F.col("field") == x[0]) & (F.col("gram") == x[1]), F.lit(1 << x[2])), [(f, g, k) for f, some in grams.items() for k, g in enumerate(some)], F)
        postings = self._read("postings", _POSTINGS).where(F.col("part").isin(parts) & F.col("gram").isin(names)).withColumn("bit", bit.otherwise(F.lit(0)))
        full = reduce(lambda c, f: c.when(F.col("field") == f, F.lit((1 << len(grams[f])) - 1)), grams, F).otherwise(F.lit(-1))
        return postings.groupBy("id", "block", "field").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == full).select("id", "block").distinct()

    def search(self, text: str, strip: bool = True) -> DataFrame:
        """The rows that hold a text in some field; strip: without white space around it."""
        needle = (text.strip() if strip else text).lower()
        rows, exact = self._read("rows"), holds(self.fields, F.lit(needle))
        if len(needle) < 3:
            return rows.where(exact).drop("batch", "block")
        grams, most = self.chosen(needle)
        if not grams:
            return rows.where(F.lit(False)).drop("batch", "block")
        if most > WIDE * self._size():
            return rows.where(exact).drop("batch", "block")
        found = self.candidates(grams)
        blocks = [r[0] for r in found.select("block").distinct().limit(FEW_BLOCKS + 1).collect()]
        if len(blocks) <= FEW_BLOCKS:
            rows = rows.where(F.col("block").isin(blocks))
        return rows.join(found.select("id"), "id", "left_semi").where(exact).drop("batch", "block")

    def search_all(self, needles: DataFrame) -> DataFrame:
        """(needle, id) for each of needles (needle) of three characters or more and each row that holds it."""
        wanted = needles.select("needle", F.lower(F.trim("needle")).alias("low")).distinct().where(F.length("low") >= 3)
        wanted = wanted.withColumn("grams", grams_of(F.col("low")))
        each = wanted.select("needle", "low", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(self.counts(), "gram")
        w = Window.partitionBy("needle", "field")
        each = each.withColumn("there", F.count("*").over(w)).where(F.col("there") == F.col("all"))
        each = each.withColumn("nth", F.row_number().over(w.orderBy("n", "gram"))).where(F.col("nth") <= RARE)
        each = each.select("needle", "low", "field", "gram", F.least("all", F.lit(RARE)).alias("wanted"))
        met = each.join(self._read("postings", _POSTINGS).select("gram", "field", "id"), ["gram", "field"])
        met = met.groupBy("needle", "low", "field", "id", "wanted").agg(F.count("*").alias("met")).where(F.col("met") == F.col("wanted"))
        pairs = met.select("needle", "low", "id").distinct()
        return pairs.join(self._read("rows").select("id", *self.fields), "id").where(holds(self.fields, F.col("low"))).select("needle", "id")
