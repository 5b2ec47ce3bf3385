"""Packing: exact round trips, full windows, differencing against all partitions."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spiderglass.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def units():
    with open(VOCABULARY, encoding="utf-8") as f:
        return packing.Tokens(f.read())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1éÉßǅ_@[^~2²½ªµ×€…—’t!'s \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\U0001f600<|>")), max_size=60))
def test_units_give_the_ids_of_the_text(tokenizer, units, text):
    assert units.split and units.ids(text).tolist() == ids_of(tokenizer, text)[:-1]


def test_long_texts_in_parts(tokenizer, units, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    monkeypatch.setattr(packing, "KEPT", 5)
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "\n", "  ", "it's", "x" * 70, "7"]) for _ in range(3000)) + "<|endoftext|>"
    assert units.ids(text).tolist() == ids_of(tokenizer, text)[:-1]


def test_other_vocabularies_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        held = packing.Tokens(f.read())
    text = "Some Words,  and more\n words"
    assert not held.split and held.ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_differencing_is_near_the_best():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 7))]
        k = rng.randint(1, 3)
        best = min(max(sum(s for s, w in zip(sizes, ways, strict=True) if w == j) for j in range(k)) for ways in itertools.product(range(k), repeat=len(sizes)))
        got = np.bincount(packing.differencing(sizes, k), sizes).max()
        assert best <= got <= best * 4 / 3 + 1e-9


def test_differencing_of_known_numbers():
    assert sorted(np.bincount(packing.differencing([4, 5, 6, 7, 8], 2), [4, 5, 6, 7, 8])) == [14, 16]
    many = [random.Random(2).randint(1, 700) for _ in range(3000)]
    sums = np.bincount(packing.differencing(many, 100), many)
    assert len(sums) == 100 and sums.max() - sums.min() <= 20
    assert packing.differencing([], 3).tolist() == [] and sorted(packing.differencing([5, 5], 3).tolist()) == [0, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.booleans())
def test_pack_keeps_every_token(sizes, cut):
    windows = packing.pack(sizes, 64, cut)
    covered = defaultdict(list)
    for window in windows:
        assert 0 < sum(n for _, _, n in window) <= 64
        for i, start, n in window:
            covered[i].append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at and n > 0
            at += n
        assert at == size and (cut or len(covered[i]) == 1)
    if cut:
        lengths = [sum(n for _, _, n in w) for w in windows]
        assert lengths.count(64) >= sum(sizes) // 64 and all(n & (n - 1) == 0 for n in lengths)
        assert sum(map(len, covered.values())) <= len(sizes) + 2 * len(windows)


def test_the_count_rises_where_whole_pieces_do_not_fit():
    assert len(packing.pack([40, 40, 40], 64, cut=False)) == 3 and len(packing.pack([40, 40, 40], 64)) == 4


def check(rows, texts, tokenizer, capacity=2048):
    """rows of pieces against the documents (a list of (doc_id, text))."""
    wanted = defaultdict(list)
    for i, t in texts:
        wanted[i].append(ids_of(tokenizer, t))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        windows[r.sequence_id].append((r.offset, r.length))
    assert {(i, len(x)) for i, all_ids in wanted.items() for x in all_ids} == set(pieces)
    for i, all_ids in wanted.items():
        for ids in all_ids:
            found = pieces[i, len(ids)]
            same = [x for x in all_ids if len(x) == len(ids)]
            assert sum(n for _, n, _ in found) == len(ids) * len(same)
            if len(same) == 1:
                at = 0
                for start, n, crc in sorted(found):
                    assert start == at and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
                    at += n
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


rng = random.Random(8)
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "two words"), (5, "same same"), (5, "same same"), (None, "no id"), (6, "<|endoftext|> x"), (7, "long text " * 40_000), (8, "q" * 5000), (9, "a" + " b" * 2046), (10, "Ünï cödé 😀 \u2003 x")]
ODD += [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "x1"], k=rng.randint(1, 1500)))) for i in range(300)]


def test_odd_rows(spark, tokenizer):
    df = spark.createDataFrame([(i, t, 1, "o") for i, t in ODD], "doc_id long, text string, start long, offset string")
    rows = packing.packed_pieces(df, VOCABULARY, block=4).collect()
    check(rows, ODD, tokenizer)
    assert packing.packed_pieces(df.limit(0), VOCABULARY).count() == 0


def test_sequences(spark, tokenizer):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    pieces = packing.packed_pieces(df, VOCABULARY, block=4)
    got = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in got) == sum(len(ids_of(tokenizer, t)) for _, t in ODD)
    assert sum(r.ids.count(1) for r in got) >= len(ODD) and all(len(r.doc_ids) == len(r.starts) for r in got)


def test_op13(spark, sf, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(packing.op13_packing(spark, sf).collect(), texts, tokenizer)
