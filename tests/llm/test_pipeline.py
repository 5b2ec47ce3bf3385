"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline as cp

from spiderglass.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark, sf, tmp_path):
    import test_documents as brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        assert set(cp.COLUMNS) <= set(out.columns)
        if name == "quality":
            kept = {i for i, _ in after}
            good = [i for i, r in labels.items() if r.quality == 1 and i < len(before)]
            assert sum(i in kept for i in good) > 0.97 * len(good)
            bad = [i for i, r in labels.items() if r.quality == 0 and i < len(before)]
            assert sum(i not in kept for i in bad) > 0.7 * len(bad)
        if name == "lines":
            seen = set()
            for i, t in sorted(after):
                for x in t.split("\n"):
                    x = x.strip(" ")
                    assert len(x) < 24 or x not in seen
                    seen.add(x)
        if name == "neardup":
            assert Counter(i for i, *_, k2 in brute.brute_components(before).elements() if k2) == Counter(i for i, _ in after)
        if name == "benchmark":
            hit = lambda rows: sum(n for *_, n in brute.brute_hits(rows, items))  # noqa: E731  documents with hits
            assert hit(before) > 0 and hit(after) == 0 and len(after) > 0.9 * len(before)
        if name == "mixing":
            assert 0.5 * len(before) < len(after) < 1.6 * len(before)
        docs = out
    assert cp.run(spark, sf).count() == len(after)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    import random

    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    twin = text(80)
    return [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, twin, "en", "s", 1), (4, twin + " more", None, "s", 1), (5, twin, "en", None, None), (5, twin, "en", None, None), (5, text(60), "en", "s", 1), (5, text(60), "en", "s", 1),
        (None, text(50), "en", "s", 1), (None, twin, "en", "s", 1), (None, None, None, None, None), (6, "\n".join([text(30), "A line that two documents share, word for word."]), "en", "t", 1),
        (7, "\n".join(["A line that two documents share, word for word.", text(30)]), "en", "t", 1), (8, text(30_000), "en", "t", 1), (9, "x" * 200_000, "en", "t", 1), (10, " \n\t\n ", "en", "t", 1), (3, twin, "en", "s", 1),
    ]


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(odd_rows(), schema)
    n_in = Counter((r[0], r[1]) for r in odd_rows())
    clash = docs.selectExpr("*", "'c' AS n_hit", "1 AS copy", "'k' AS kept", "2 AS score", "3 AS row", "4 AS removed")
    for table in (docs, clash):
        out = {name: [(r.doc_id, r.text) for r in stage(spark, table, sf).select("doc_id", "text").collect()] for name, stage in cp.STAGES}
        assert set(out["quality"]) <= set(n_in)
        ids = Counter(i for i, _ in out["lines"])
        assert ids[6] == 1 and ids[1] == 1 and ids[2] == 1 and ids[8] == 1 and ids[9] == 1
        texts = dict(out["lines"])
        assert ("share, word" in texts[6]) and ("share, word" not in texts[7])
        kept = Counter(out["neardup"])
        twin = odd_rows()[2][1]
        # Of the twins (3, 4, 5 and both rows of 3) one stays; a row without an id is linked with none.
        assert kept[(3, twin)] == 1 and kept[(4, twin + " more")] == 0 and kept[(5, twin)] == 0 and kept[(None, twin)] == 1
        assert set(kept.values()) == {1} and sum(k[0] == 5 for k in kept) == 2 and kept[(None, None)] == 1 and kept[(1, None)] == 1 and kept[(2, "")] == 1
        assert Counter(out["benchmark"]) == n_in
        assert set(out["mixing"]) <= set(n_in)


def test_stages_on_an_empty_table(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_items_with_nulls_and_no_labels(spark, sf, tmp_path):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, None), (1, ""), (2, "no such item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.benchmark_stage(spark, docs, str(tmp_path)).count() == docs.count()
    # Without a label nothing is known against any document.
    assert cp.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()
