"""Hard negatives, spelling variants and nearest neighbours, against brute force and on odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, neighbours, spelling

# ---- 11


def brute_negatives(rows, anchors):
    """rows: (id, label, vec) of whole numbers, in any order; ids are unique."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, vec in rows:
        if a not in anchors:
            continue
        scored = sorted((-dot(vec, v), i, own) for i, own, v in rows if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(n, k) for n, k, own in scored if own != label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a, i, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(fits[:5])]
    return sorted(out)


def mined(spark, rows, anchors, **bounds):
    df = spark.createDataFrame(rows, "id long, label int, vec array<bigint>")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id").isin(*anchors), **bounds).collect())


@pytest.mark.parametrize("spread", [3, 40])
def test_negatives_against_brute_force(spark, spread):
    draw = random.Random(spread)
    centres = [[draw.randint(-60, 60) for _ in range(24)] for _ in range(6)]
    rows = [(i, i % 7 % 3, [c + draw.randint(-spread, spread) for c in centres[i % 6]]) for i in range(400)]
    anchors = set(range(0, 400, 17))
    # several blocks of rows and of anchors
    assert mined(spark, rows, anchors, block_cells=24 * 90, block_anchors=10) == brute_negatives(rows, anchors)


def test_negatives_among_many_copies(spark):
    """Ties by id, within a crowd of equal rows, and windows that only zero fits."""
    rows = [(i, i % 2, [10, 0, 0]) for i in range(300)] + [(1000 + i, i % 2, [0, 5, 0]) for i in range(4)]
    anchors = {0, 1, 299, 1001}
    assert mined(spark, rows, anchors, block_cells=150) == brute_negatives(rows, anchors)


def test_negatives_of_odd_rows(spark):
    rows = [(1, 1, [3, 4]), (2, 1, [3, 4, 0]), (3, 2, [3]), (4, 2, [-3, -4]), (5, 3, []), (6, 2, [4, 3]), (7, None, [3, 4]), (8, 2, None), (None, 2, [3, 4])]
    fine = [r for r in rows if None not in r]
    assert mined(spark, rows, {1, 2, 3, 4, 5}) == brute_negatives([(i, lab, [*v, 0, 0, 0][:3]) for i, lab, v in fine], {1, 2, 3, 4, 5})
    assert mined(spark, [], {1}) == [] and mined(spark, rows, {99}) == []
    # a row that repeats is a row of its own
    twice = mined(spark, [(1, 1, [5]), (1, 1, [5]), (2, 2, [5])], {1})
    assert twice == [(1, 1, 1, 2, 25, 25)] * 2


def test_negatives_of_huge_numbers(spark):
    """Beyond what doubles hold exactly."""
    rows = [(i, i % 2, [2**28 + i % 5, 2**27 + i, 7 * i]) for i in range(30)]
    assert mined(spark, rows, {0, 3}) == brute_negatives(rows, {0, 3})


def test_pairs_above_is_exact():
    draw = np.random.default_rng(3)
    x, q = draw.integers(-50, 50, (300, 70)).astype(float), draw.integers(-50, 50, (20, 70)).astype(float)
    whole = q @ x.T
    for least in (0.0, 4000.0, 9000.0, 15000.0, 1e6):
        i, j, s = negatives.pairs_above(x, q, np.full(20, least))
        assert sorted(zip(i, j, s)) == sorted((a, b, whole[a, b]) for a, b in zip(*np.nonzero(whole >= least)))


def test_scaled(spark):
    df = spark.createDataFrame([([1.5, -0.001],), ([None, 1.0],), ([float("nan")],), ([float("inf")],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(negatives.scaled(F.col("v"))).collect()] == [[384, -1], None, None, None, None, []]


# ---- 12


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_words(docs):
    n = Counter()
    for id_, text in docs:
        run = ""
        for c in lower(text) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{id_}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if id_ is not None and h % 199 == 0 else run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    close = {a: [b for b in n if abs(len(a) - len(b)) < 2 and near(a, b)] for a in n}
    form = {}
    for a, bs in close.items():
        best = min(bs, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 5 * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], len(close[a]), n[form[a]] if form[a] else None))
    return sorted(out)


def variants(words_df, **bounds):
    return sorted(tuple(r) for r in spelling.spelling_variants(words_df, **bounds).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("pass_bytes", [32 << 20, 256])
def test_variants_against_brute_force(spark, pass_bytes):
    """Filters in one pass, and in many of which a length takes several."""
    draw = random.Random(5)
    n = Counter()
    for _ in range(900):
        w = "".join(draw.choice("aàéz") for _ in range(draw.randint(6, 9)))
        n[w] += draw.choice([5, 6, 30, 31, 200, 5000])
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variants(df, pass_bytes=pass_bytes) == brute_variants(n)


def test_words_and_variants_of_documents(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["Colour", "colour's", "COLOUR-colours", "coloured", "Österreich", "österreich", "ÀÉÎÕÜß", "x" * 6, "rivière²rivières"]) for _ in range(200)) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "colour " * 7), (1, None), (2, ""), (3, "y" * 50_000 + " " + "y" * 50_000), (3, "colour"), (3, "colour")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "a.b")})
    words = spelling.counted_words(df, "doc_id", "text").filter("n >= 5")
    n = brute_words(docs)
    assert dict(words.collect()) == n
    assert any(len(w) == 6 and w not in " ".join(texts) for w in n) or len(n) > 10  # damaged ones are among them
    assert variants(words) == brute_variants(n)
    assert variants(words.filter("n < 0")) == []


def test_very_long_words(spark):
    rows = [("b" * 3000, 100), ("b" * 2999, 5), ("b" * 1500 + "c" + "b" * 1499, 7), ("b" * 2998, 1)]
    assert variants(spark.createDataFrame(rows, "word string, n long")) == brute_variants(dict(rows))


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r[1] for r in spelling.roots(chain).collect()} == {"w21"}


# ---- 13


def found(spark, vectors, queries, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], "id long, vec array<double>")
    rows = neighbours.nearest(df, F.coalesce(F.col("id").isin(*queries), F.lit(False)), **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def brute_nearest(vectors, query, k):
    own = dict(vectors)[query]
    return sorted((-float(np.dot(own, v)), i) for i, v in vectors if i != query)[:k]


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, lengths):
    """Vectors without any clusters, the hardest case; of one length, and of many."""
    draw = np.random.default_rng(11)
    x = draw.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths:
        x *= draw.uniform(0.5, 1.5, (4000, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = list(range(0, 4000, 40))
    rows = found(spark, vectors, queries)
    assert len(rows) == 2000
    hits = 0
    for q in queries:
        mine = [r for r in rows if r[0] == q]
        assert [r[1] for r in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda r: (-r[3], r[2]))
        assert all(abs(r[3] - x[q] @ x[r[2]]) < 1e-12 and r[2] != q for r in mine)
        hits += len({r[2] for r in mine} & {i for _, i in brute_nearest(vectors, q, 20)})
    assert hits / 2000 >= 0.95


def test_copies_and_odd_vectors(spark):
    """A crowd of equal vectors: the smallest ids are found; what takes no part; fewer candidates than asked for."""
    crowd = [(i, [1.0, 0.0, 0.0]) for i in range(500)]
    rest = [(1000 + i, [1.0, 0.01 * i, 0.0]) for i in range(1, 40)]
    out = [(2000, None), (2001, []), (2002, [0.0, 0.0]), (2003, [float("nan"), 1.0]), (2004, [None, 1.0]), (2005, [float("inf")]), (None, [1.0, 1.0, 1.0])]
    rows = found(spark, crowd + rest + out, [0, 30, 1001, 2000, 2002], k=20)
    assert [r[2] for r in rows if r[0] == 0] == list(range(1, 21)) and [r[2] for r in rows if r[0] == 30] == list(range(20))
    assert {r[0] for r in rows} == {0, 30, 1001}
    assert found(spark, out, [2000]) == [] and found(spark, crowd, [7777]) == []
    few = found(spark, [(1, [1.0, 2.0]), (2, [2.0]), (2, [2.0]), (3, [-1.0, 0.0])], [1, 2])
    assert [(r[0], r[2], r[3]) for r in few] == [(1, 2, 2.0), (1, 2, 2.0), (1, 3, -1.0), (2, 2, 4.0), (2, 2, 4.0), (2, 1, 2.0), (2, 1, 2.0), (2, 3, -2.0), (2, 3, -2.0)]


def test_near_copies_stay_reachable(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.standard_normal((600, 16)), draw.standard_normal(16) + 0.01 * draw.standard_normal((600, 16))])
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = list(range(0, 1200, 30))
    rows = found(spark, vectors, queries)
    hits = sum(len({r[2] for r in rows if r[0] == q} & {i for _, i in brute_nearest(vectors, q, 20)}) for q in queries)
    assert hits / (20 * len(queries)) >= 0.9
