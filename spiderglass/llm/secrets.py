"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns. Where a match stands follows from the pieces between matches:
split() and regexp_extract_all() walk the same leftmost non-overlapping matches, so the lengths of
pieces and matches interleaved give every start and end in code points.

Linking: weak candidates (an access identifier too short to count alone, a bare key-like run of 40
characters, a service endpoint) mean little alone. Parts are put into buckets of SCOPE code points
and interval-joined (each part to the buckets it reaches), and a weak candidate is reported when a
complementary part lies within SCOPE code points of it in the same document: a secret-like run needs
an access identifier or an endpoint, a short identifier needs a secret, an endpoint needs an identifier
and a secret. Each bucket spans a fixed stretch of one document, so no document or source grows one.

Edge cases: a null or empty text has no spans; equal spans of different kinds all count; rows with
repeated doc_ids are scanned each for itself; an empty table gives no rows; columns other than doc_id
and text are not read. Patterns match ASCII letters only in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean, let, stash, table

# The base patterns, their kinds in the order of listing, and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Weak parts of a credential.
SHORT_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,}(?![A-Za-z0-9])"
BARE_KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]{1,5})?"
SCOPE = 400


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end>> of the pattern's matches in text, in code points, end exclusive."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(x: Column) -> Column:
        lengths = F.transform(x["found"], F.length)
        gaps = F.transform(F.slice(x["pieces"], 1, F.size(x["found"])), F.length)
        # Walk once over the matches: `at` is where the last one ended.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["n"]).alias("at"),
            F.when(m["ok"], F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["n"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        )
        oks = F.transform(x["found"], keep if keep else lambda m: F.lit(True))
        zipped = F.transform(F.arrays_zip(gaps.alias("g"), lengths.alias("l"), oks.alias("k")), lambda z: F.struct(z["g"].alias("gap"), z["l"].alias("n"), z["k"].alias("ok")))
        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return let(F.struct(pieces.alias("pieces"), found.alias("found")), place)


NONE = "array<struct<start:int,end:int>>"


def base_spans(text: Column, low: Column) -> dict[str, Column]:
    """Spans of each kind; cheap tests keep texts without a keyword away from the patterns."""
    none = F.array().cast(NONE)
    word = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]
    # A run of hex digits or of an identifier that is too short holds no longer one, so the least
    # length may stand in the pattern; an assignment's remainder may hold another, so there it may not.
    access, runs = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+"
    return {
        "assign": F.when(word, spans(text, ASSIGN, value)).otherwise(none),
        "access": F.when(text.contains("AKIA"), spans(text, access)).otherwise(none),
        "hex": F.when(text.rlike(runs), spans(text, runs)).otherwise(none),
    }


def _joined(found: Column) -> Column:
    """kind:start:end by start, then rank, joined by commas."""
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


KINDS = ["assign", "access", "hex", "short_id", "bare_key", "endpoint"]
#: What part of a credential a kind can be.
PART = {"assign": "key", "access": "id", "hex": "key", "short_id": "id", "bare_key": "key", "endpoint": "endpoint"}
_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _listed(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(r1, r2, linked): the weak parts of a row with a complementary part within scope, from (r1, r2, p)."""
    weak = F.col("p.rank") >= 3
    one = parts.select("r1", "r2", "p", F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])[F.col("p.kind")].alias("part"))
    left = one.where(weak).select("r1", "r2", "p", "part", F.explode(F.sequence(F.floor((F.col("p.start") - scope) / scope), F.floor((F.col("p.end") + scope) / scope))).alias("bucket"))
    right = one.select("r1", "r2", F.col("p").alias("q"), F.col("part").alias("q_part"), F.floor(F.col("p.start") / scope).alias("bucket"))
    # A long part reaches over several buckets; it stands in each, so both of its ends are met.
    right = right.union(one.select("r1", "r2", F.col("p").alias("q"), F.col("part").alias("q_part"), F.explode(F.expr(f"sequence(floor(p.start / {scope}) + 1, greatest(floor(p.start / {scope}) + 1, floor(p.end / {scope})))")).alias("bucket")).where(F.floor(F.col("q.end") / scope) >= F.col("bucket")))
    near = (F.col("q.start") <= F.col("p.end") + scope) & (F.col("q.end") >= F.col("p.start") - scope)
    has = lambda part: F.max(near & (F.col("q_part") == part))
    inside = F.max((F.col("q.rank") < 3) & (F.col("q.start") <= F.col("p.start")) & (F.col("q.end") >= F.col("p.end")))
    met = left.join(right, ["r1", "r2", "bucket"]).groupBy("r1", "r2", "p").agg(has("id").alias("id"), has("key").alias("key"), has("endpoint").alias("endpoint"), inside.alias("inside"))
    needs = F.when(F.col("p.kind") == "short_id", F.col("key")).when(F.col("p.kind") == "bare_key", F.col("id") | F.col("endpoint")).otherwise(F.col("id") & F.col("key"))
    return met.where(needs & ~F.col("inside")).groupBy("r1", "r2").agg(F.collect_list("p").alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row of docs (doc_id, text)."""
    none = F.array().cast(NONE)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("r2"), clean("text").alias("text"))
    rows = rows.select("*", F.lower("text").alias("low"))
    hint = F.col("text").contains("://") | F.col("text").rlike("A(?:KIA|SIA|IDA|ROA)")
    found = rows.select(
        "doc_id", "r1", "r2", *[c.alias(k) for k, c in base_spans(F.col("text"), F.col("low")).items()],
        F.when(hint, spans(F.col("text"), SHORT_ID)).otherwise(none).alias("short_id"),
        F.when(hint, spans(F.col("text"), BARE_KEY)).otherwise(none).alias("bare_key"),
        F.when(F.col("text").contains("://"), spans(F.col("text"), ENDPOINT)).otherwise(none).alias("endpoint"),
    )
    # The texts are read once; from here on only spans move.
    found = stash(found, "spans")
    weak = found.where("size(short_id) + size(bare_key) + size(endpoint) > 0")
    parts = weak.select("r1", "r2", F.explode(F.concat(*[_listed(k) for k in KINDS])).alias("p")).distinct()
    found = found.join(linked(parts, scope), ["r1", "r2"], "left")
    base, more = F.concat(*[_listed(k) for k in KINDS[:3]]), F.coalesce("linked", F.array().cast(f"array<{_SPAN}>"))
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, more)).alias("spans"), size(more).alias("n_linked"),
    )


def op3_secrets(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
