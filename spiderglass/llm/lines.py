"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines (trimmed) are one class, named by two hashes and represented by its first occurrence (by
doc_id, then line number). Two classes of lines of at least MIN_CHARS code points are linked when their
edit distance is at most EDITS.

Candidates: a line of length l is cut into EDITS + 1 segments; EDITS edits leave one of them intact. A
probing line of length n looks, for every length l from n - EDITS to n, at the substrings that can still
stand against each segment (multi-match-aware windows: their number depends on EDITS only). Index and
probe keys are hashes of (length, segment, substring) and meet in an equi-join. Equal lines are merged,
with partial aggregates, before any key travels. Every key of a line is written and shuffled once: the probes that are its
index keys too are the index joined with itself.

Before a pair becomes a row, the join compares sketches of its lines: 64 parities of hashed words. An edit
changes three words at most (a blank put in or taken out makes two words of one, or one of two), so lines
whose sketches differ in more than 3 * EDITS bits can't link. Where more than CROWD lines share a segment, their
texts are fetched for a second sketch, 64 parities of characters, of which an edit changes two, and 64 * WORDS of
pairs of characters, of which it changes four. These texts travel with the key, and what passes both sketches is verified
in the join: so a crowd of lines that each have some other word than one line makes no rows but its links.

Hot segments: where more than HOT lines do, say the many variants of one line, their pairs
are not tried. Those lines are cut into PARTS segments. A pair's edits lie in one of them, and then its key
is all the rest, or (with two edits) one in each of two, and then its key is all but these two. Where that is
hot again, only what the key leaves out is cut again, in the group of the key: the one segment as the line
was, the two segments into three parts each, of which a key leaves out one and one; and so on down to single
characters. Groups of two segments go on only if both vary. So a storm of variants costs a few keys a
line and level, and a line is compared with at most HOT lines a key, or with those that differ in single
characters. With EDITS above 2 pairs come from segments alone.

Candidates are verified with a banded bit-parallel edit distance: a band of 2 * EDITS + 1 bits slides
along the diagonal, a few word operations a column, over what is left between the lines' common ends (found
by bisection), until the distance can only be above EDITS. Two lines of a finer key are equal but for what it
leaves out, so where that is short it is compared instead, in the join: with one segment it has the lines'
distance, with two the sum of theirs is at least that, and is it under the key whose segments have an edit each.
So a storm compares a few characters a pair, with Spark's own bounded distance; the text itself moves only for hot lines and for other candidates. Links are pairs of classes, named by 64 bits until both classes are looked up.

Edge cases: null texts and empty texts have no line; shorter lines are never linked, and have a class and
copies where `short` is set (as in op2 and `remove_lines`), else a null class and are never removed; the
same holds for blank lines always; a very long line is one row, whose keys are hashes; lines that differ in outer spaces only are equal; a line equal to or linked to an
earlier one is removed, whether or not that earlier one is removed itself; rows equal in doc_id and
text count as one row; a null doc_id comes before all others; an empty table gives no rows; columns other than doc_id and text pass through
`remove_lines` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean, freed_shuffles, let, stash, table

EDITS, MIN_CHARS = 2, 24
#: Lines of a segment's key beyond which they get the second sketch.
CROWD = 32
#: Words of 64 pair parities in the second sketch.
WORDS = 4
#: Lines of a segment's key that a probe is compared with; beyond that they are cut finer, into PARTS segments,
#: and two segments that have an edit each into HALVES each.
HOT, PARTS, HALVES = 512, 6, 3
#: Characters up to which what a hot key leaves out travels with the key, so that a pair is verified by it.
TRAVELS = 16
#: Rows of ids up to which they are broadcast (16 bytes each), else they are joined by a shuffle.
FEW = 500_000


def _segment(l: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a line of length l; the longer segments stand last."""
    base, short = F.floor(l / parts).cast("int"), parts - l % parts
    return base * i + F.greatest(i - short, F.lit(0)) + 1, base + F.when(i >= short, 1).otherwise(0)


def _each(line: Column, n: Column, params: list[tuple], body) -> Column:
    """body(line, n, one of params) for all params: an array that is walked, so the code stays small."""
    names = [f"p{k}" for k in range(len(params[0]))]
    made = F.expr(f"array({', '.join('named_struct(' + ', '.join(f'{k!r}, {v}' for k, v in zip(names, p, strict=True)) + ')' for p in params)})")
    return let(F.struct(line.alias("line"), n.alias("n")), lambda x: F.transform(made, lambda p: body(x["line"], x["n"], *[p[k] for k in names])))


def segment_keys(line: Column, n: Column, edits: int) -> tuple[Column, Column]:
    """Index keys of a line, and those of its probe keys that are not among them."""
    parts, probes = edits + 1, []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            # Lines of one length probe each other. With one edit before and one after the middle segment it has moved right in one
            # of them, and stands in the other's probe; or the later edit is at its very end, and the last segment is the same.
            low = 0 if shorter == 0 and edits <= 2 else low
            probes += [(shorter, i, move) for move in range(low, high + 1) if shorter or move]

    def key(shorter: int, i: int, move: int) -> Column:
        start, size = _segment(n - shorter, F.lit(i), parts)
        return F.xxhash64(n - shorter, F.lit(i), F.substring(line, start + move, size))

    return F.array(*[key(0, i, 0) for i in range(parts)]), F.array(*[key(*p) for p in probes]).cast("array<long>")


def finer_cuts(g: Column, x: Column, n: Column, edits: int, parts: int) -> tuple[Column, Column]:
    """Index and probe cuts of a string x of group g: (key, hi, hj, x, y), x and y being what the key leaves out
    (y is null for one segment) and hi, hj the hashes of two. An index cut has the string's own length, a probe cut
    that of a string up to `edits` shorter."""

    def one(line: Column, n: Column, shorter: Column, i: Column) -> Column:
        start, size = _segment(n - shorter, i, parts)
        key = F.xxhash64(g, n - shorter, i, F.substring(line, F.lit(1), start - 1), F.substring(line, start + size + shorter, n))
        none = F.lit(None).cast("long")
        return F.struct(key.alias("key"), none.alias("hi"), none.alias("hj"), F.substring(line, start, size + shorter).alias("x"), F.lit(None).cast("string").alias("y"))

    def two(line: Column, n: Column, shorter: Column, more: Column, i: Column, j: Column) -> Column:
        # Of `shorter` added characters `more` stand in segment i; each segment has one edit.
        (start, size), (start2, size2) = _segment(n - shorter, i, parts), _segment(n - shorter, j, parts)
        left, right = F.substring(line, start, size + more), F.substring(line, start2 + more, size2 + shorter - more)
        between = F.substring(line, start + size + more, start2 - start - size)
        key = F.xxhash64(g, n - shorter, i, j, F.substring(line, F.lit(1), start - 1), between, F.substring(line, start2 + size2 + shorter, n))
        return F.struct(key.alias("key"), F.xxhash64(left).alias("hi"), F.xxhash64(right).alias("hj"), left.alias("x"), right.alias("y"))

    def cuts(lengths: list[int]) -> Column:
        found = _each(x, n, [(s, i) for s in lengths for i in range(parts)], one)
        if edits == 1:
            return found
        shared = [(a + b, a) for a in (-1, 0, 1) for b in (-1, 0, 1) if a + b in lengths]
        return F.concat(found, _each(x, n, [(*s, i, j) for s in shared for i in range(parts) for j in range(i + 1, parts)], two))

    return cuts([0]), cuts(list(range(edits + 1)))


def pair_cuts(g: Column, x: Column, y: Column, parts: int) -> tuple[Column, Column]:
    """The same for strings x and y of which each has one edit: keys leave out a segment of each. A probe is the
    string of the longer x, or of the longer y where the x are as long."""

    def cuts(moves: list[tuple[int, int]]) -> Column:
        made = F.expr(f"array({', '.join(f'named_struct("dx", {dx}, "dy", {dy}, "u", {u}, "v", {v})' for dx, dy in moves for u in range(parts) for v in range(parts))})")

        def cut(s: Column, p: Column) -> Column:
            kept, left = [], []
            for name, more, i in (("x", "dx", "u"), ("y", "dy", "v")):
                m = F.length(s[name]) - p[more]
                start, size = _segment(m, p[i], parts)
                kept += [m, F.substring(s[name], F.lit(1), start - 1), F.substring(s[name], start + size + p[more], F.length(s[name]))]
                left.append(F.substring(s[name], start, size + p[more]))
            return F.struct(F.xxhash64(g, p["u"], p["v"], *kept).alias("key"), F.xxhash64(left[0]).alias("hi"), F.xxhash64(left[1]).alias("hj"), left[0].alias("x"), left[1].alias("y"))

        return let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.transform(made, lambda p: cut(s, p)))

    return cuts([(0, 0)]), cuts([(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])


def word_parities(line: Column) -> Column:
    """64 parities of the hashes of a line's words."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(line, " ", -1), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, F.xxhash64(w).bitwiseAND(F.lit(63)).cast("int"))))


def pair_parities(line: Column) -> Column:
    """64 parities of the hashes of a line's neighbouring characters, blanks at its ends included."""
    one = F.lit(1).cast("long")
    bit = lambda a, b: F.call_function("shiftleft", one, F.xxhash64(a, b).bitwiseAND(F.lit(63)).cast("int"))
    chars = F.regexp_extract_all(F.concat(F.lit(" "), line, F.lit(" ")), F.lit("(?s)."), F.lit(0))
    return let(chars, lambda c: F.aggregate(F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)))


def second_sketch(line: Column) -> Column:
    """64 parities of the hashes of a line's characters (c), and 64 of those of its neighbouring characters in each of WORDS
    words (w0 and so on) to which the pairs are dealt."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    chars = F.regexp_extract_all(F.concat(F.lit(" "), line, F.lit(" ")), F.lit("(?s)."), F.lit(0))
    hashes = let(chars, lambda c: F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), lambda x, y: F.struct(F.xxhash64(x).alias("c"), F.xxhash64(x, y).alias("w"))))

    def step(acc: Column, h: Column) -> Column:
        dealt = F.pmod(F.shiftright(h["w"], 6), F.lit(WORDS))
        return F.struct(acc["c"].bitwiseXOR(bit(h["c"])).alias("c"), *[acc[f"w{k}"].bitwiseXOR(F.when(dealt == k, bit(h["w"])).otherwise(zero)).alias(f"w{k}") for k in range(WORDS)])

    return F.aggregate(hashes, F.struct(zero.alias("c"), *[zero.alias(f"w{k}") for k in range(WORDS)]), step)


def _between_ends(x: Column, y: Column, keep: int) -> Column:
    """(x, y) without what both begin and end with, but for `keep` characters of it or a few more on each side."""

    def shared(most: Column, part) -> Column:
        """The largest number of bytes up to most for which both parts are equal."""

        def step(acc: Column, _: Column) -> Column:
            def then(m: Column) -> Column:
                return let(part("x", m) == part("y", m), lambda same: F.struct(F.when(same, m).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(F.greatest(m - 1, acc["lo"])).alias("hi")))

            return F.when(acc["lo"] == acc["hi"], acc).otherwise(let(F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int"), then))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(most + F.lit(2))).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda acc: acc["lo"])

    def ends(b: Column) -> Column:
        most = F.least(b["nx"], b["ny"])
        head = shared(most, lambda z, k: F.substring(b[z], F.lit(1), k))

        def rest(h: Column) -> Column:
            tail = shared(most - h, lambda z, k: F.substring(b[z], b[f"n{z}"] - k + 1, k))
            # Bytes at the inner end of what is shared may be a part of a character, or up to three of them.
            first = F.greatest(F.length(F.substring(b["x"], F.lit(1), h).cast("string")) - 1 - keep, F.lit(0))
            last = let(tail, lambda t: F.greatest(F.length(F.substring(b["x"], b["nx"] - t + 1, t).cast("string")) - 3 - keep, F.lit(0)))
            mid = lambda z, e: F.substring(z, e["first"] + 1, F.length(z) - e["first"] - e["last"])
            return let(F.struct(first.alias("first"), last.alias("last")), lambda e: F.struct(mid(x, e).alias("x"), mid(y, e).alias("y")))

        return let(head, rest)

    return let(F.struct(x.cast("binary").alias("x"), y.cast("binary").alias("y"), F.octet_length(x).alias("nx"), F.octet_length(y).alias("ny")), ends)


def distance_within(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of two lines longer than `edits`, exact up to edits and else above it."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    return let(_between_ends(x, y, edits + 1), lambda s: let(F.struct(chars(s["x"]).alias("x"), chars(s["y"]).alias("y")), lambda c: banded_distance(c["x"], c["y"], edits)))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters whose sizes differ by at most edits (and exceed it);
    what it gives above edits only says that the distance is above edits."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    num = lambda x: F.lit(x).cast("long")
    rows = F.size(a)

    def column(acc: Column, j: Column) -> Column:
        match = [F.when(F.get(a, j - edits + bit) == F.get(b, j), num(1 << bit)).otherwise(num(0)) for bit in range(width)]
        x = sum(match[1:], match[0])
        vp, vn = acc["vp"], acc["vn"]

        def then(s: Column) -> Column:
            x = s["x"]
            zero = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(num(full))

            def last(z: Column) -> Column:
                d0 = z["d"]
                hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(num(full)))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                # While the band's lowest row is above the last row the distance follows the diagonal, then the last row.
                bit = rows - 1 - j + edits
                along = F.when(j < rows - edits, F.lit(1) - F.shiftright(d0, width - 1).cast("int")).otherwise((_bit(hp, bit) - _bit(hn, bit)).cast("int"))
                return F.struct(hn.bitwiseOR(down.bitwiseOR(hp).bitwiseXOR(num(full))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (acc["n"] + along).alias("n"))

            return let(F.struct(zero.alias("d")), last)

        # From 3 * edits on the last row can't bring the distance down to edits.
        return F.when(acc["n"] > 3 * edits, acc).otherwise(let(F.struct(x.alias("x")), then))

    start = F.struct(num(full - ((1 << edits) - 1)).alias("vp"), num(0).alias("vn"), F.lit(edits).alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, column, lambda acc: acc["n"])


def _bit(word: Column, bit: Column) -> Column:
    return F.call_function("shiftright", word, F.greatest(bit, F.lit(0))).bitwiseAND(F.lit(1).cast("long"))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, r, line_no, line, n): every line of every text, trimmed, with its length."""
    each = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r"), F.posexplode(F.split(clean("text"), "\n", -1)).alias("line_no", "line"))
    return each.select("doc_id", "r", "line_no", F.trim("line").alias("line")).select("*", F.length("line").alias("n"))


def _met(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, a2), a < a2, of lines that share a key and may link by their sketches (and, where two segments
    have an edit each, differ in both); with the lines (line), or what their key leaves out (x, y), only those within edits.
    The index as its own probe is shuffled once: both sides are the same exchange."""
    columns, same = index.columns, probe is index
    one, two = (lambda c: F.col(f"index.{c}")), (lambda c: F.col(f"probe.{c}"))
    ok = (one("a") < two("a")) if same else (one("a") != two("a"))
    apart = lambda c: F.bit_count(one(c).bitwiseXOR(two(c)))
    ok = (one("key") == two("key")) & ok & (apart("p") <= 3 * edits)
    if "q" in columns:
        ok = ok & (apart("q.c") <= 2 * edits) & (sum((apart(f"q.w{k}") for k in range(1, WORDS)), apart("q.w0")) <= 4 * edits)
    if "hi" in columns:
        ok = ok & (one("hi").isNull() | ((one("hi") != two("hi")) & (one("hj") != two("hj"))))
    pair = F.least(one("a"), two("a")).alias("a"), F.greatest(one("a"), two("a")).alias("a2")
    if "line" in columns:
        # After the sketches, so it is computed for few of a key's pairs. This is work, not volume: keys are dealt out, however small they are.
        told, parts = F.levenshtein(one("line"), two("line"), edits), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probe, index = probe.repartition(parts, "key"), index.repartition(parts, "key")
        return probe.alias("probe").join(index.alias("index"), ok & (told >= 0)).select(*pair, told.alias("distance"))
    both = probe.alias("probe").join(index.alias("index"), ok)
    if "x" not in columns:
        return both.select(*pair, F.lit(None).cast("int").alias("distance"))
    # What the key leaves out tells the distance, where it is short enough to travel; else the texts will.
    dx, dy = (F.levenshtein(one(c), two(c), edits) for c in "xy")
    alone = one("hi").isNull()
    there = one("x").isNotNull() & two("x").isNotNull() & (alone | (one("y").isNotNull() & two("y").isNotNull()))
    told = both.select(*pair, F.when(there, F.when(alone, dx).when((dx < 0) | (dy < 0), -1).otherwise(dx + dy)).alias("distance"))
    return told.where((F.col("distance").isNull()) | F.col("distance").between(0, edits))


def _finer(rows: DataFrame, edits: int, hot: int) -> list[DataFrame]:
    """Pairs of the lines of hot keys; rows (g, a, p, q, x, y): a group, a line, its sketches, the string that may differ in
    the group, or the two of which each has an edit."""
    travels = lambda c: F.when(F.length(c) <= TRAVELS, F.col(c)).alias(c)
    found, ends = [], ["key", "a", "p", "q", "hi", "hj", travels("x"), travels("y")]
    while True:
        one, two = finer_cuts(F.col("g"), F.col("x"), F.length("x"), edits, PARTS), pair_cuts(F.col("g"), F.col("x"), F.col("y"), HALVES)
        each = [rows.where("y is null").select("a", "p", "q", F.explode(c).alias("c")).union(rows.where("y is not null").select("a", "p", "q", F.explode(d).alias("c"))) for c, d in zip(one, two, strict=True)]
        index, probe = (df.select("a", "p", "q", "c.*") for df in each)
        # What is of single characters is not cut again.
        long = F.greatest(F.length("x"), F.length("y")) > 1
        crowded = stash(index.groupBy("key").agg(F.count("*").alias("rows"), F.max(long).alias("long")).where((F.col("rows") > hot) & F.col("long")).select("key"), "hot-keys")
        if crowded.isEmpty():
            return [*found, _met(index.select(*ends), probe.select(*ends), edits)]
        found.append(_met(index.join(crowded, "key", "left_anti").select(*ends), probe.select(*ends), edits))
        both = index.union(probe).join(crowded, "key", "left_semi")
        varied = both.groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in ("hi", "hj") for n, f in (("lo", F.min), ("up", F.max))])
        varied = varied.where("lo_hi is null or (lo_hi <> up_hi and lo_hj <> up_hj)").select("key")
        rows = stash(both.join(varied, "key", "left_semi").select(F.col("key").alias("g"), "a", "p", "q", "x", "y").distinct(), "hot-rows")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(at, line): the texts of lines at places (at)."""
    few = places.count() <= FEW
    wanted = places.select("at.doc_id", "at.r").distinct()
    wanted, places = (F.broadcast(wanted), F.broadcast(places)) if few else (wanted, places)
    return split_lines(_of(docs, wanted)).select(F.struct("doc_id", "r", "line_no").alias("at"), "line", "n").join(places, "at", "left_semi").distinct()


def _classed(min_chars: int, short: bool) -> Column:
    """Whether a line has a class."""
    long = F.col("n") >= min_chars
    return long | F.col("line").rlike(r"\S") if short else long


def link_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes (a, b, first, copies) and links between them (a, b, first; a2, b2, first2; distance)."""
    docs = docs.select("doc_id", "text")
    lines = split_lines(docs).where(_classed(min_chars, short))
    index, probe = segment_keys(F.col("line"), F.col("n"), edits)
    # Keys are made inside the aggregate, where generated code is cut into methods that the JVM compiles, and once a class and task.
    keys = F.when(F.col("n") >= min_chars, F.struct(index.alias("index"), probe.alias("probe"), word_parities(F.col("line")).alias("p")))
    named = lines.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(3), "line").alias("b"), F.struct("doc_id", "r", "line_no").alias("at"), "line", "n")
    classes = stash(named.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("copies"), F.first(keys).alias("keys")), "line-classes")
    index, probe = (classes.where("keys is not null").select("a", F.col("keys.p").alias("p"), F.explode(f"keys.{c}").alias("key")) for c in ("index", "probe"))
    crowded = stash(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowded-keys")
    found = []
    if not crowded.isEmpty():
        hot = index.union(probe).join(crowded, "key", "left_semi").select("a").distinct()
        index = index.join(crowded, "key", "left_anti")
        texts = _texts(docs, stash(classes.join(hot, "a", "left_semi").select(F.col("first").alias("at")), "line-places"))
        texts = stash(texts.select(F.xxhash64("line").alias("a"), word_parities(F.col("line")).alias("p"), second_sketch(F.col("line")).alias("q"), "line"), "hot-texts")
        own, other = segment_keys(F.col("line"), F.length("line"), edits)
        again = [texts.select("a", "p", "q", "line", F.explode(k).alias("key")).join(crowded, "key", "left_semi") for k in (own, F.concat(own, other))]
        very = crowded.where((F.col("n") > HOT) & F.lit(edits in (1, 2))).select("key")
        found.append(_met(again[0].join(very, "key", "left_anti"), again[1], edits))
        if not very.isEmpty():
            # Both ends of a pair under a hot key are cut finer, so that the pair meets there.
            ends = again[1].join(very, "key", "left_semi").select("a").distinct()
            rows = texts.join(ends, "a", "left_semi").select(F.lit(0).cast("long").alias("g"), "a", "p", "q", F.col("line").alias("x"), F.lit(None).cast("string").alias("y"))
            found += _finer(stash(rows, "hot-rows"), edits, HOT)
    pairs = _met(index, probe, edits).union(_met(index, index, edits))
    for more in found:
        pairs = pairs.union(more)
    lone = classes.select("a", "b", "first")
    other = lone.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("first").alias("first2"))
    # A pair that some key has told needs no texts.
    pairs = stash(pairs.groupBy("a", "a2").agg(F.min("distance").alias("told")).join(lone, "a").join(other, "a2"), "line-pairs")
    told, pairs = pairs.where("told is not null"), pairs.where("told is null").drop("told")
    texts = stash(_texts(docs, stash(pairs.select(F.explode(F.array("first", "first2")).alias("at")).distinct(), "line-places")), "line-texts")
    both = pairs.join(texts.select(F.col("at").alias("first"), F.col("line").alias("x")), "first").join(texts.select(F.col("at").alias("first2"), F.col("line").alias("y")), "first2")
    # Verification is work, not volume: it is dealt out evenly, whatever the pairs' size in bytes.
    both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b", "a2", "b2")
    # The distance is computed once: as the one element, or none, that a row is exploded by.
    within = F.explode(F.filter(F.array(distance_within(F.col("x"), F.col("y"), edits)), lambda d: d <= edits)).alias("distance")
    links = ["a", "b", "first", "a2", "b2", "first2"]
    return classes.drop("keys"), stash(both.select(*links, within).union(told.select(*links, F.col("told").alias("distance"))), "line-links")


def _of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r"))
    # The first place of a line may be in a document with a null doc_id.
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("r").alias("_r"))
    return keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("r") == F.col("_r")), "left_semi").select("doc_id", "text")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """A row for each line: doc_id, line_no, class_doc_id and class_line_no (the first equal line), copies,
    n_links (different lines within edits), and removed (an earlier line is equal or linked). With `short`,
    lines under min_chars too have their exact class."""
    docs = docs.select("doc_id", "text")
    with freed_shuffles(docs.sparkSession):
        classes, links = link_lines(docs, edits, min_chars, short)
    ends = links.select("a", "b", (F.col("first2") < F.col("first")).alias("late")).union(links.select("a2", "b2", (F.col("first") < F.col("first2")).alias("late")))
    degree = ends.groupBy("a", "b").agg(F.count("*").alias("n_links"), F.max("late").alias("late"))
    known = classes.join(degree, ["a", "b"], "left").select("a", "b", "first", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("late", F.lit(False)).alias("late"))
    lines = split_lines(docs)
    classed = _classed(min_chars, short)
    lines = lines.select("doc_id", "r", "line_no", F.when(classed, F.xxhash64("line")).alias("a"), F.when(classed, F.xxhash64(F.lit(3), "line")).alias("b"))
    found = lines.where("a is not null").join(known, ["a", "b"]).select(
        "doc_id", "r", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "copies", "n_links",
        (F.col("late") | (F.struct("doc_id", "r", "line_no") != F.col("first"))).alias("removed"),
    )
    rest = lines.where("a is null").select("doc_id", "r", "line_no", F.lit(None).cast(docs.schema["doc_id"].dataType), F.lit(None).cast("int"), F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(False))
    return found.union(rest)


def remove_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that repeat an earlier one; a document all of whose lines go, goes too."""
    gone = line_classes(docs, edits, min_chars, short=True).groupBy("doc_id", "r").agg(F.sort_array(F.collect_set(F.struct("line_no", "removed"))).alias("_flags"), F.max("removed").alias("_some"))
    gone = gone.where("_some").select(F.col("doc_id").alias("_d"), F.col("r").alias("_r2"), "_flags")
    rows = docs.withColumn("_r", F.xxhash64("doc_id", "text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_r") == F.col("_r2")), "left")
    kept = F.filter(F.zip_with(F.split(clean("text"), "\n", -1), "_flags", lambda x, f: F.struct(x.alias("line"), f["removed"].alias("removed"))), lambda s: ~s["removed"])
    rows = rows.withColumn("_text", F.when(F.col("_flags").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n")))
    rows = rows.where(F.col("_flags").isNull() | (F.trim(F.regexp_replace("_text", r"\s+", " ")) != ""))
    return rows.select(*[F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir):
    found = line_classes(table(spark, sf_dir, "documents"), short=True)
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "copies", "n_links", "removed")
