"""Rows in the result schema with defaults."""

from spiderglass import schema
from spiderglass.operators.ingest import coerce

_DEFAULTS = {"status": 200, "resourceType": "HTML", "isIndexable": True, "isNoindex": False, "isNofollow": False}


def results(spark, rows):
    """rows: dicts with JSON keys (and id, sessionId); missing keys get defaults."""
    import json

    lines = [json.dumps(_DEFAULTS | {"id": i + 1, "sessionId": 1} | r) for i, r in enumerate(rows)]
    fields = schema.T.StructType([*[schema.T.StructField(k, t) for _, t, k in schema.PROMOTED], *schema.SEO.fields])
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", fields).alias("r")).select("r.*")
    return coerce(df)
