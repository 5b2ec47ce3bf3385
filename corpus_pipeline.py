"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from spiderglass.llm.common import shared_dir, table
from spiderglass.llm.decontaminate import decontaminate
from spiderglass.llm.lines import remove_lines
from spiderglass.llm.mixing import mix
from spiderglass.llm.neardup import near_duplicates
from spiderglass.llm.quality import classify

#: Documents at least so alike, on five-word shingles, are near duplicates.
NEARDUP_PERCENT = 80

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    scored = classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.where("predicted = 1").select(*COLUMNS)


def lines_stage(spark, docs, sf_dir):
    """Lines that repeat an earlier line go; n_chars is counted anew."""
    return remove_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def neardup_stage(spark, docs, sf_dir):
    """Of each group of near duplicates one document with the smallest doc_id stays."""
    judged = near_duplicates(docs, NEARDUP_PERCENT, with_row=True).where("kept")
    # Rows of one doc_id are told apart by their text; of rows that share both, or a group and its doc_id, one stays.
    kept = judged.groupBy("doc_id", "group", F.when(F.col("group").isNull(), F.col("row")).alias("r"))
    kept = kept.agg(F.min("row").alias("_row")).select(F.col("doc_id").alias("_id"), "_row")
    rows = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left_semi")
    # Only where rows repeat whole do the texts travel once more.
    again = judged.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    return rows if again.isEmpty() else rows.withColumn("_row", F.xxhash64("text")).dropDuplicates(["doc_id", "_row"]).select(*COLUMNS)


def benchmark_stage(spark, docs, sf_dir):
    """Passages of test items leave the texts; documents that are mostly such passages go."""
    clean = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), remove=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark, docs, sf_dir):
    """Documents are repeated to the sources' target weights and shuffled globally."""
    return mix(docs.select(*COLUMNS))


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("neardup", neardup_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage)]

#: The classifier is learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what a stage returns is written to the shared folder and read back."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}-{name}")
