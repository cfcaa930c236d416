"""Substring dedup, clustering and fill-in-the-middle against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barlake.llm import batch_words, clusters, infill, queries, substrings, words
from tests.compare import close, of_duckdb, of_spark
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    names, ours = of_spark(queries.queries()[name](spark, SF))
    expected, theirs = of_duckdb(queries.oracle_sql()[name], SF)
    assert names == expected and len(ours) == len(theirs) > 0
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if not close(a, b)]
    assert not wrong, (len(wrong), wrong[:3])


def removed(rows, size=13):
    """{(id, words kept, number removed): rows}, each window looked up among all."""
    each = [(i, brute.SPACE.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in each:
        for k in range(len(w) - size + 1) if i is not None else ():
            run = tuple(w[k : k + size])
            least[run] = min(i, least.get(run, i))
    out = Counter()
    for i, w in each:
        gone = {k + j for k in range(len(w) - size + 1) if i is not None and least[tuple(w[k : k + size])] < i for j in range(size)}
        out[i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)] += 1
    return out


def test_substrings(docs, rows, none):
    found = substrings.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in found) == removed(rows)
    assert substrings.remove_repeats(none).count() == 0


def test_ends_of_factors(spark):
    """Passages cut short, shifted and patched together, from documents that hold parts of each other; repeated ids."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(60)}" for _ in range(400)]
    made = [(None, " ".join(base)), (3, " ".join(base[:30])), (3, " ".join(base[5:60])), (3, " ".join(base[5:60])), (7, " ".join(base[:12])), (8, " ".join(base[:13]))]
    for i in range(10, 260):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            at = draw.randrange(380)
            parts += base[at : at + draw.randrange(8, 40)] + [f"n{draw.randrange(3)}"] * draw.randrange(2)
        made.append((i, " ".join(parts)))
    made += [(1000 + i, " ".join(base[100:160])) for i in range(300)]
    found = substrings.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in found) == removed(made)


def plain_lloyd(rows, k=16, rounds=3):
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in hashed[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        found = [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in vectors]
        for n in range(len(centroids)) if turn < rounds else ():
            own = [v for (_, v), (_, m) in zip(vectors, found, strict=True) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(vectors, found, strict=True))


def _vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "'x' AS distance")
    return df, [(r.vec_id, r.embedding) for r in df.collect()]


def test_lloyd(spark):
    draw = np.random.default_rng(2)
    middle = draw.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + 0.3 * draw.normal(size=64)).tolist()) for i in range(3000)]
    rows += [(5000 + i, middle[0].tolist()) for i in range(1500)]  # one vector many times
    rows += [(9000, None), (9001, []), (9002, [0.0] * 63), (9003, [float("nan")] + [0.0] * 63), (9004, [float("inf")] + [0.0] * 63), (9005, [None] + [0.0] * 63), (9006, [0.0] * 64), (9006, [1.0] * 64), (9006, [1.0] * 64), (None, [0.5] * 64), (9007, [-0.001] * 64)]
    df, plain = _vectors(spark, rows)
    found = clusters.lloyd(df.repartition(5)).collect()
    assert Counter(tuple(r) for r in found) == plain_lloyd(plain)


def test_few_and_large_vectors(spark):
    df, plain = _vectors(spark, [(i, [float(i % 2)] * 64) for i in range(5)])  # ties, centroids that are equal and empty
    assert Counter(tuple(r) for r in clusters.lloyd(df).collect()) == plain_lloyd(plain)
    assert clusters.lloyd(df.limit(0)).count() == 0
    df, _ = _vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)])
    assert {r.vec_id: r.distance for r in clusters.lloyd(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_trees_drop_pairs():
    """Bounds leave few pairs where vectors are in groups, and the nearest stay the nearest."""
    draw = np.random.default_rng(4)
    middle = draw.integers(-5000, 5000, size=(16, 64))
    points = (middle[np.arange(1024) % 16] + draw.integers(-50, 50, size=(1024, 64))).astype(np.int64)
    tree, top = clusters.grow(points), clusters.grow(middle, 1)
    for t, p in ((tree, points), (top, middle)):
        leaves = t.leaf(np.arange(len(t.radius)))
        assert sorted(t.order.tolist()) == list(range(len(p))) and leaves.any()
        for n in range(len(t.radius)):
            own = p[t.order[t.nodes["from"][n] : t.nodes["to"][n]]]
            assert np.sqrt(((own - p[t.nodes["centre"][n]]) ** 2).sum(1)).max() <= t.radius[n] * (1 + 1e-9)
    found, apart = clusters.nearest(points, tree, middle, top)
    exact = ((points[:, None, :] - middle[None]) ** 2).sum(2)
    assert (found == exact.argmin(1)).all() and (apart == exact.min(1)).all() and len(tree.radius) > 16


def cut(text, i, units):
    text = text or ""
    each = re.findall(units, text)
    n = len(each)
    digest = hashlib.sha256(("1:" + ("" if i is None else str(i))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(each[:a]), "".join(each[a:b]), "".join(each[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    return i, n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), out, text


@pytest.mark.parametrize(("unit", "pattern"), [(infill.CHARS, r"(?s)."), (infill.WORDS, r"\s*\S+\s*|\s+"), (infill.LINES, r"[^\n]*\n|[^\n]+$")])
def test_infill(spark, docs, rows, none, unit, pattern):
    odd = [(i, "".join(random.Random(i).choice("<PSM> é😀\n") for _ in range(i % 1100))) for i in range(300)]
    odd += [(7, "a<M>b"), (8, "<P><S><M>"), (9, "x" * infill.RUN), (10, "y" * 2 * infill.RUN), (13, "ab é" * infill.RUN), (11, "<"), (11, "<"), (12, "S>" * 40)]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS n", "'z' AS form", "2 AS output", "3 AS id", "4 AS key_1")
    for table, plain in ((docs, rows), (more, odd)):
        found = infill.fill_in_middle(table, unit).collect()
        assert Counter(tuple(r) for r in found) == Counter(cut(t, i, pattern) for i, t in plain)
    assert infill.fill_in_middle(none, unit).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 400])
def test_words_of_a_batch(chunk):
    """Words are told apart as by ``split`` whatever batch they are in: short, long, of odd bytes; equal ones hash alike."""
    draw = random.Random(9)
    some = ["a", "ab", "ba", "x" * 7, "x" * 8, "x" * 9, "y" * 64, "y" * 65, "y" * 64 + "z", "é ü", "\x1c\x00", "\x00", "\x00\x00", "日本" * 4]
    texts = [None, "", "  ", "\t\x0b", *["".join(draw.choice(some) + draw.choice([" ", "\n", "\r\f"]) for _ in range(draw.randrange(40))) for _ in range(300)], "end", "start"]
    of, seen = {}, 0
    for i in range(0, len(texts), chunk):
        hashes, ends = batch_words.hashes(pa.array(texts[i : i + chunk], pa.string()))
        for k, t in enumerate(texts[i : i + chunk]):
            each = words.split(t)
            assert ends[k + 1] - ends[k] == len(each)
            for w, h in zip(each, hashes[ends[k] : ends[k + 1]].tolist(), strict=True):
                assert of.setdefault(w, h) == h
                seen += 1
    assert seen > 1000 and len(set(of.values())) == len(of)
