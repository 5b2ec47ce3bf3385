"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the weighted set of its word pairs (lower-cased; the weight is how often a pair occurs). A sample of
a weighted set is drawn by improved consistent weighted sampling: for each term of weight S, with r and c of
the distribution Gamma(2, 1) and b uniform, all three made from the term's hash alone,

    t = floor(ln(S) / r + b)      ln(a) = ln(c) - r * (t - b + 1)

and the sample is the pair (term, t) of the least a. Two sets give the same sample with the probability of
their generalised Jaccard similarity, the sum of the lesser weights over that of the greater.

A fingerprint has BINS samples. Drawing each of them over all terms would cost BINS evaluations a term, so the
weight is spread over the bins first: a term of weight w is w units, each unit goes to a bin by its hash, and
a term's weight in a bin is the number of its units there. Of two texts the one with the greater weight has
the other's units and more, so the lesser and greater weights of the bins add up to those of the texts, heavy
terms fill bins in proportion to their weight, and the likeness of two fingerprints, the share of equal samples
among the bins that either text fills, estimates the generalised Jaccard similarity. A term is evaluated once
in each bin that it fills, at most once a word in all.

The next document (by descending doc_id) is found in one shuffle of the texts: rows are dealt to ranges of
(doc_id, hash of text), and the top row of each range also goes, as a ghost, to the end of the range
above it. Ranges end at keys from a sample of bounded size (SAMPLE keys a range, those of least hash), and a
row finds its range by bisection; so any type of doc_id will do, and a repeated doc_id is split over ranges
by its texts. Their number follows the shuffle partitions, and a range is sorted with spilling.

Edge cases: a very long text is an array of its words' hashes in one row (16 bytes a word); null and empty
texts have an empty fingerprint, which is like (1.0) only to another empty one; a text of one word has that word as its only term; equal texts have equal fingerprints; of equal
doc_ids the one with the smaller text hash comes first; a null doc_id comes after all others; in a
table of one row it is its own next document; an empty table gives no rows; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean, let, table

#: Up to 128: a bin is written before ln(a) and name in a long that sorts by bin, then by ln(a).
BINS = 128
#: Bits of a sample's name and of its rank in the bin.
NAME_BITS, RANK_BITS = 24, 32
#: Ranges of doc_id for each shuffle partition, and keys in the sample for each range.
RANGES, SAMPLE = 4, 24
#: How the ends of ranges are written without loss.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def terms(text: Column) -> Column:
    """array<long>: sorted hashes of the word pairs (of the word, if there is one only)."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def pairs(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        # Neighbours by position; the pair's hash depends on the order of its words.
        both = lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return let(hashes, lambda h: F.when(F.size(h) > 1, F.sort_array(both(h))).otherwise(h))

    return let(words, pairs)


def _gamma(h: Column) -> Column:
    """A variate of Gamma(2, 1): less the logarithm of the product of two uniforms, which are the halves of a hash."""
    halves = (F.shiftrightunsigned(h, 32) + F.lit(0.5)) * (h.bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(0.5))
    return F.lit(64 * math.log(2)) - F.log(halves)


def sample(key: Column, weight: Column) -> Column:
    """The sample of a term in a bin (key: bin, then bits of the term's hash) as a long: bin, ln(a), name of (term, t)."""
    r, c = _gamma(F.xxhash64(F.lit(11), key)), _gamma(F.xxhash64(F.lit(12), key))
    b = (F.shiftrightunsigned(F.xxhash64(F.lit(13), key), 32) + F.lit(0.5)) * F.lit(2.0**-32)

    def packed(r: Column, t: Column, rest: Column) -> Column:
        # ln(a) lies between -90 and 5 for all weights that an array can have.
        rank = F.floor((F.log(c) - r * rest + F.lit(96.0)) * F.lit(float(1 << (RANK_BITS - 8))))
        bits = F.shiftleft(F.shiftrightunsigned(key, RANK_BITS + NAME_BITS), RANK_BITS + NAME_BITS)
        return bits.bitwiseOR(F.shiftleft(rank, NAME_BITS)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(key, t), 64 - NAME_BITS))

    heavy = let(r, lambda r: let(F.floor(F.log(weight.cast("double")) / r + b), lambda t: packed(r, t, t - b + F.lit(1.0))))
    # ln(1) is 0, and so is t: most terms are of that weight.
    return F.when(weight == 1, packed(r, F.lit(0).cast("long"), F.lit(1.0) - b)).otherwise(heavy)


def of_terms(sorted_terms: Column, bins: int = BINS) -> Column:
    """array<long>: for each filled bin, in order, bin << NAME_BITS | name of its sample. Terms are sorted hashes, a term
    of weight w standing w times."""
    as_before = lambda s, x, i: (i > 0) & (F.get(s, i - 1) == x)
    edges = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~as_before(s, F.get(s, i), i))
    # Where each run of equal values starts; the next start less this one is its length.
    runs = lambda s, made: let(s, lambda s: F.when(F.size(s) > 0, let(edges(s), lambda e: F.transform(e, lambda i, k: made(F.get(s, i), F.coalesce(F.get(e, k + 1), F.size(s)) - i)))))
    none = F.array().cast("array<long>")

    def unit(term: Column, j: Column) -> Column:
        return F.shiftleft(F.pmod(F.xxhash64(F.lit(5), term, j), F.lit(bins)), RANK_BITS + NAME_BITS).bitwiseOR(F.shiftrightunsigned(term, 64 - RANK_BITS - NAME_BITS))

    def units(s: Column) -> Column:
        first = F.transform(F.filter(s, lambda x, i: ~as_before(s, x, i)), lambda x: unit(x, F.lit(0)))
        more = runs(F.filter(s, lambda x, i: as_before(s, x, i)), lambda term, n: F.transform(F.sequence(F.lit(1), n), lambda j: unit(term, j)))
        return F.sort_array(F.concat(first, F.coalesce(F.flatten(more), none)))

    def samples(u: Column) -> Column:
        # A term with one unit in a bin stands alone; the others are few, as a rule.
        twin = lambda x, i: as_before(u, x, i) | F.coalesce(F.get(u, i + 1) == x, F.lit(False))
        single = F.transform(F.filter(u, lambda x, i: ~twin(x, i)), lambda x: sample(x, F.lit(1)))
        return F.concat(single, F.coalesce(runs(F.filter(u, twin), sample), none))

    def least(packed: Column) -> Column:
        first = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.shiftright(x, RANK_BITS + NAME_BITS) != F.shiftright(F.get(p, i - 1), RANK_BITS + NAME_BITS)))
        name = lambda x: F.shiftleft(F.shiftright(x, RANK_BITS + NAME_BITS), NAME_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << NAME_BITS) - 1)))
        return let(F.sort_array(packed), lambda p: F.transform(first(p), name))

    return let(sorted_terms, lambda s: F.when(F.size(s) > 0, let(let(units(s), samples), least)).otherwise(none))


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The fingerprint of a text's word pairs; that of a null text is empty."""
    return F.coalesce(of_terms(terms(text), bins), F.array().cast("array<long>"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples among the bins that either fingerprint fills."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, NAME_BITS))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(fp: Column) -> Column:
    """Two hex digits a bin, then the sample's name; filled bins only."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), (NAME_BITS + 8) // 4, "0")), "")


def _bisected(cuts: Column, n: int, key: Column) -> Column:
    """How many of the n sorted cuts are less than key."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        less = F.get(cuts, mid) < key
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(less, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(less, acc["hi"]).otherwise(mid).alias("hi"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(n, 1).bit_length())), start, step, lambda acc: acc["lo"])


def with_next(rows: DataFrame, made: dict[str, Column], carried: list[str]) -> DataFrame:
    """rows (doc_id, text) with the made columns and the struct `next` of the carried columns of the next row by
    descending doc_id (after the last: the first). The made columns are computed after the shuffle."""
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of equal doc_ids the one with the smaller text hash comes first.
    rows = rows.select("*", F.struct("doc_id", F.bitwise_not(F.xxhash64("text")).alias("h")).alias("key"))
    share = ranges * SAMPLE / max(1, rows.count())
    drawn = rows.select("key", F.rand(7).alias("u")).agg(F.sort_array(F.collect_list(F.when(F.col("u") < share, F.col("key")))).alias("s"), F.max("key").alias("top"))
    cuts = F.array_distinct(F.concat(F.filter("s", lambda k, i: (i + 1) % SAMPLE == 0), F.filter(F.array("top"), lambda k: k.isNotNull())))
    found, n = drawn.select(cuts.alias("cuts")).select(F.to_json("cuts", _EXACT), F.size("cuts")).first()
    cuts = F.from_json(F.lit(found), T.ArrayType(rows.schema["key"].dataType), _EXACT)
    # Range i ends at cut i, which is the key of a row: that row also goes to the end of the range above, or of all.
    rows = rows.select("*", _bisected(cuts, n, F.col("key")).alias("range"))
    here, above = F.struct(F.col("range").alias("to"), F.lit(0).alias("ghost")), F.struct(((F.col("range") + 1) % max(n, 1)).alias("to"), F.lit(1).alias("ghost"))
    rows = rows.select("*", F.explode(F.when(F.get(cuts, F.col("range")).eqNullSafe(F.col("key")), F.array(here, above)).otherwise(F.array(here))).alias("g"))
    rows = rows.select("doc_id", "text", "key", "g.to", "g.ghost").repartition("to").withColumns(made)
    window = Window.partitionBy("to").orderBy("ghost", F.desc("key"))
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(window)).where("ghost = 0").drop("to", "ghost", "key")


def fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs."""
    rows = docs.select("doc_id", clean("text").alias("text"))
    rows = with_next(rows, {"fp": fingerprint(F.col("text"), bins)}, ["text", "fp"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", "fp", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.fp").alias("next_fp"))
    rows = rows.select("doc_id", "fp", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), bins).alias("edited_fp"), "next_fp")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op4_fingerprint(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
