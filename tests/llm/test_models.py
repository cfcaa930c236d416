"""Classifiers by held-out accuracy, mixing by its marginals, the pipeline by what each stage must hold."""

from __future__ import annotations

import weakref
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlake.llm import frames, ftrl, held, labels, mixing, packing, rule_ensemble, toxicity, words
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("module", "column", "bound"), [(rule_ensemble, "quality", 0.85), (toxicity, "toxic", 0.85)])
def test_classifier(spark, module, column, bound):
    """Rank measure (the share of right pairs of a 1 and a 0) on rows never trained on, odd rows scored too."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "w " * 50_000), (None, "no id")], "doc_id long, text string")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    found = module.classify(own.union(odd), marks)
    rows = found.join(marks, "doc_id", "left").select("doc_id", "held_out", "score", column).collect()
    assert len(rows) == own.count() + 4 and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, r[column]) for r in rows if r.held_out and r[column] is not None]
    ones, zeros = (np.array([s for s, k in held if k == v]) for v in (1, 0))
    right = (ones[:, None] > zeros).mean() + 0.5 * (ones[:, None] == zeros).mean()
    print(column, len(ones), len(zeros), right)
    assert right >= bound
    assert module.classify(own.limit(0), marks).count() == 0
    assert module.classify(odd, marks.limit(0)).count() == 4


def test_ftrl_is_sparse():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(1, 500, 20)) for _ in range(400)]
    labels = draw.integers(0, 2, 400).astype(float)
    rows = [np.unique(np.append(r, 0)) if y else r for r, y in zip(rows, labels, strict=True)]
    fits = [ftrl.fit(rows, labels, 500, l1=k) for k in (0.1, 2.0, 8.0)]
    counts = [int((w[:500] != 0).sum()) for w in fits]
    assert counts[0] > counts[1] > counts[2]
    assert all(w[0] == w[:500].max() > 0 for w in fits)  # the one feature that tells


def test_mixing(spark):
    """Raked weights meet every marginal; the sample's expected tokens are the share to keep."""
    made = [(i, "w " * (1 + i % 50) + f"t{i % 7}", ["web", "web", "web", None, "book"][i % 5], ["en", "de", None][i % 3]) for i in range(600)] + [(None, None, None, None), (7, "", "web", "en")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, lang string")
    targets = {"lang": {"en": 0.6, "de": 0.3}}
    rows = mixing.mix(docs, targets=targets, keep=0.5, rounds=8).collect()  # null languages have no share: two thirds could be kept
    assert len(rows) == len(made)
    tokens = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) / tokens - 0.5) < 0.01
    weight = defaultdict(float)
    for r in rows:
        if r.n_tokens:
            weight[r.lang] += r.n_tokens * r.rate
    total = sum(weight.values())
    assert abs(weight["en"] / total - 2 / 3) < 0.01 and abs(weight["de"] / total - 1 / 3) < 0.01 and weight[None] == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
    kept = mixing.sample(docs).columns
    assert kept == docs.columns


def test_raking_against_a_plain_version(spark):
    """Weights by cell, the scale and the draw's probabilities as plain loops over the cells have them; tempered targets."""
    made = [(i, "w " * (1 + i * i % 97), f"s{i % 5 * i % 4}", ["en", "de", None][i % 3], ["a", "b"][i // 7 % 2]) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, topic string")
    rows = mixing.mix(docs, keep=0.6).collect()
    cells = defaultdict(int)
    for m in made:
        cells[m[2:]] += len(m[1].split())
    keys, tokens = list(cells), np.array(list(cells.values()), float)
    weight = tokens.copy()
    for _ in range(60):
        for k, power in enumerate((0.7, 0.9, 0.8)):
            values = {v: [i for i, key in enumerate(keys) if key[k] == v] for v in {key[k] for key in keys}}
            goal = {v: tokens[at].sum() ** power for v, at in values.items()}
            for v, at in values.items():
                weight[at] *= goal[v] / sum(goal.values()) / weight[at].sum()
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * weight / tokens)).sum() < 0.6 * tokens.sum() else (low, mid)
    expected = dict(zip(keys, np.minimum(1, low * weight / tokens), strict=True))
    assert len(rows) == len(made)
    assert all(abs(r.probability - expected[r.source, r.lang, r.topic]) < 0.005 for r in rows)


def test_mixing_judges_rows_that_repeat_an_id_by_themselves(spark):
    made = [(i % 50, "some words " * (1 + i), ["web", "book"][i % 2], "en", "x", "clash") for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, n_tokens string, own string")
    targets = {"source": {"web": 1.0}}
    kept = mixing.sample(docs, targets=targets, keep=0.9)
    assert kept.columns == docs.columns
    assert {r.source for r in kept.collect()} == {"web"} and {r.n_tokens for r in kept.collect()} == {"x"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ruled = stages["quality_rules"](spark, docs, "").cache()
    assert ruled.columns == docs.columns
    assert {r.doc_id for r in ruled.collect()} <= {r.doc_id for r in docs.collect() if not brute.lines(r.text)[-1]}
    alone = stages["near_duplicates"](spark, ruled, "").cache()
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in ruled.collect()])
    assert Counter(r.doc_id for r in alone.collect()) == Counter(i for i, (_, c) in groups.items() if i == c)
    clean = stages["personal_data"](spark, alone, "").cache()
    assert clean.count() == alone.count() and clean.columns == docs.columns
    assert not [r.doc_id for r in clean.collect() if any(k in ("email", "card") for _, _, k, _ in brute.personal(r.text))]
    mixed = stages["mixing"](spark, clean, "").cache()
    assert 0 < mixed.count() <= clean.count() and mixed.columns == docs.columns
    assert stages["packing"](spark, mixed, "").select("doc_id").distinct().count() == mixed.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] > 0


def test_mixing_topics(spark):
    """The table's topics are used; without any, texts with like words share one; all three marginals are met; no match is an error."""
    made = [(i, "w " * (1 + i % 50), ["web", "book"][i % 2], ["en", "de"][i // 2 % 2], ["news", "law", None][i // 4 % 3]) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"web": 0.5, "book": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"news": 0.7, "law": 0.3}}
    rows = mixing.mix(docs, targets=targets, keep=0.3).collect()
    assert {r.row_id: (r.topic, r.n_tokens) for r in rows} == {m[0]: (m[4], len(m[1].split())) for m in made}
    total = sum(r.n_tokens * r.rate for r in rows)
    for c, shares in targets.items():
        for value, share in shares.items():
            assert abs(sum(r.n_tokens * r.rate for r in rows if r[c] == value) / total - share) < 0.01, (c, value)
    with pytest.raises(ValueError, match="topic"):
        mixing.mix(docs, targets={"topic": {"sports": 1.0}})
    draw = np.random.default_rng(2)
    about = [(i, " ".join(f"s{i % 4}v{j}" for j in draw.integers(0, 60, 40)), "web", "en") for i in range(200)]
    topics = defaultdict(set)
    for r in mixing.mix(spark.createDataFrame(about, "doc_id long, text string, source string, lang string")).collect():
        topics[r.topic].add(r.row_id % 4)
    assert all(len(v) == 1 for v in topics.values())


def _odd_ones(spark):
    """(documents, ids of the odd ones): 4,200 texts, of which 100 share no word with the others. By the hash that the fitting
    draws rows with, they are the last."""
    order = [r.id for r in spark.range(4200).orderBy(F.xxhash64("id", F.lit(mixing.SEED))).collect()]
    odd, draw = set(order[-100:]), np.random.default_rng(3)
    made = [(i, " ".join(f"{'odd' if i in odd else 'word'}{j}" for j in draw.integers(0, 40, 30)), "web", "en") for i in range(4200)]
    return spark.createDataFrame(made, "doc_id long, text string, source string, lang string"), odd


def test_mixing_topics_are_fitted_on_all_documents(spark):
    docs, odd = _odd_ones(spark)
    found = {}
    for parts in (1, 7):
        rows = mixing.measured(docs.repartition(parts), frames.Scratch(spark, "test")).select("row_id", "topic").collect()
        found[parts] = {r.row_id: r.topic for r in rows}
    topics = found[1]
    assert found[7] == topics and len(topics) == 4200
    assert not {topics[i] for i in odd} & {t for i, t in topics.items() if i not in odd}


def test_pipeline_mixes_by_topics_of_all_documents(spark, monkeypatch):
    """The stage fits on every document; a topic of 100 in 4,200 is rare enough to be kept whole by the default targets."""
    docs, odd = _odd_ones(spark)
    fit, seen = mixing.fit_topics, []
    monkeypatch.setattr(mixing, "fit_topics", lambda rows: (seen.append(len(rows) if isinstance(rows, list) else rows.count()), fit(rows))[1])
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()}
    assert seen == [4200]
    assert odd <= kept and len(kept) < 4200


def test_toxicity_keeps_the_class_shares(spark):
    """A text that tells nothing scores the share of label 1 among all labels, though the bounds took as many of each."""
    docs = spark.createDataFrame([(i, "the very same words") for i in range(2000)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 10 = 0 AS INT) AS toxic")
    weights = toxicity.train(docs, marks, per_class=(100, 100))
    score = 1 / (1 + np.exp(-(weights[toxicity.features("the very same words")].sum() + weights[-1])))
    assert 0.03 < score < 0.25


def test_ranges_of_ids_by_bytes():
    assert toxicity.cut([], 10) == []
    assert toxicity.cut([(1, 4), (2, 6), (3, 1), (7, 25), (9, 0), (12, 10)], 10) == [(1, 2), (3, 3), (7, 7), (9, 12)]
    draw = np.random.default_rng(3)
    sizes = [(i, int(x)) for i, x in enumerate(draw.integers(0, 40, 200))]
    made = toxicity.cut(sizes, 50)
    assert [i for lo, hi in made for i, _ in sizes[lo : hi + 1]] == list(range(200))
    assert all(lo == hi or sum(x for _, x in sizes[lo : hi + 1]) <= 50 for lo, hi in made)


def test_toxicity_trains_by_pieces(spark):
    """A bound of a few kilobytes makes many pieces, read again in each pass; the weights tell the classes like those of one
    piece."""
    draw = np.random.default_rng(4)
    made = [(i, " ".join(f"w{k}" for k in draw.integers(0, 300, 60)) + (" vile" if i % 3 == 0 else " kind")) for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    whole = toxicity.train(docs, marks)
    parts = toxicity.train(docs, marks, piece=20_000)
    for w in (whole, parts):
        vile, kind = (w[toxicity.features(x)].sum() + w[-1] for x in ("vile", "kind"))
        assert vile > 0 > kind
    total = lambda w, t: w[toxicity.features(t)].sum() + w[-1]
    assert np.mean([(total(whole, t) > 0) == (total(parts, t) > 0) for _, t in made]) > 0.98


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, an empty table, and columns named like what the stages make, which stay as they were."""
    words_ = " ".join(f"word{i} and" for i in range(30))
    made = [(1, words_ + " mail a@b.co", "en", "web", 9), (1, words_ + " mail a@b.co", "en", "web", 9), (2, None, None, None, None), (3, "", "en", None, 0), (None, words_ + " without an id", None, "web", 1), (4, "short", "de", "web", 5)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'own' AS kept", "'own' AS cleaned", "'own' AS pii", "'own' AS n_tokens", "'own' AS marks")
    for name, stage in corpus_pipeline.STAGES[:4]:
        for given in (docs, docs.limit(0)):
            rows = stage(spark, given, "")
            assert rows.columns == docs.columns, name
            assert all(r[c] == "own" for r in rows.collect() for c in ("kept", "cleaned", "pii", "n_tokens", "marks")), name
    assert Counter(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == {1: 2, None: 1}
    clean = {(r.doc_id, r.text) for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert (2, None) in clean and (1, words_ + " mail [EMAIL]") in clean
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_training_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 1) for i in range(50)] + [(2, None, 0)], "doc_id long, text string, label int")
    found = labels.one_each(docs).collect()
    assert sorted((r.doc_id, r.label) for r in found) == [(1, 1), (2, 0)]


def test_ftrl_against_a_plain_version():
    """The vectorised fit and a loop over single coordinates, as the method is published, give the same weights."""
    draw = np.random.default_rng(6)
    dims, rows = 40, [np.unique(draw.integers(0, 40, 6)) for _ in range(120)]
    y, weight = draw.integers(0, 2, 120).astype(float), draw.uniform(0.5, 2, 120)
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.1
    z, n = [0.0] * (dims + 1), [0.0] * (dims + 1)

    def at(i):
        limit = 0.0 if i == dims else l1
        return 0.0 if abs(z[i]) <= limit else -(z[i] - np.sign(z[i]) * limit) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(120):
            now = {int(i): at(int(i)) for i in (*rows[k], dims)}
            g = (1 / (1 + np.exp(-sum(now.values()))) - y[k]) * weight[k]
            for i, w in now.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
                n[i] += g * g
    made = ftrl.fit(rows, y, dims, alpha, beta, l1, l2, passes=2, seed=5, weight=weight)
    assert np.allclose(made, [at(i) for i in range(dims + 1)], atol=1e-6) and (made == 0).any()


def test_sparse_totals():
    """Sums over the nonzero weights only are those over all; no features, no weights, no texts."""
    draw = np.random.default_rng(8)
    dense = np.where(draw.random(toxicity.DIMS + 1) < 0.01, draw.normal(size=toxicity.DIMS + 1), 0).astype(np.float32)
    found = [np.empty(0, np.int64), *[np.unique(draw.integers(0, toxicity.DIMS, k)) for k in (1, 500, 20_000)], np.empty(0, np.int64)]
    assert np.allclose(toxicity.totals(found, *toxicity.sparse(dense)), [dense[x].sum(dtype=float) + dense[-1] for x in found])
    assert len(toxicity.totals([], *toxicity.sparse(dense))) == 0
    assert toxicity.totals(found, *toxicity.sparse(np.zeros(toxicity.DIMS + 1, np.float32))).tolist() == [0.0] * 5


def test_compiled_rules(spark):
    """The column expression gives what the rules give in numpy, at their bounds too."""
    draw = np.random.default_rng(9)
    k = len(rule_ensemble.STATISTICS)
    x = draw.integers(0, 6, (300, k)) / 2.0
    y = ((x[:, 0] > 1) & (x[:, 3] <= 1.5) | (draw.random(300) < 0.1)).astype(float)
    rules, intercept = rule_ensemble.fit(x, y, np.ones(300))
    rules.append((((2, True, 1.0), (5, False, 1.5)), 0.75))  # bounds that are values of the data
    plain = 1 / (1 + np.exp(-(intercept + sum(w * rule_ensemble.holds(r, x) for r, w in rules))))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *rule_ensemble.STATISTICS])
    made = [r.score for r in rows.select("i", rule_ensemble.compiled(rules, intercept).alias("score")).orderBy("i").collect()]
    assert len(rules) > 3 and np.allclose(made, plain)


def test_a_worker_holds_one_table():
    """The token table goes when the worker takes up words, and comes again with the same ids."""
    path, texts = packing.vocabulary_path(), ["some words here", None, "some more"]
    first = [x.tolist() for x in packing.token_ids(path, texts)]
    table = weakref.ref(held.held(f"tokens of {path}", dict))
    hashes = words.word_hashes([b"some", b"words"])
    assert table() is None and list(held._held) == ["words"]
    assert [x.tolist() for x in packing.token_ids(path, texts)] == first and len(held._held) == 1
    assert words.word_hashes([b"words", b"some"]).tolist() == hashes[::-1].tolist()


def test_toxicity_holds_one_piece(spark, monkeypatch):
    """What the driver holds of the training features is a piece of the bound's bytes, and the piece before is gone."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 301}" for k in range(60))) for i in range(300)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    sizes, before, left, fit = [], [], [], ftrl.fit_pieces

    def watched(pieces, *args, **kwargs):
        def read(k):
            left.extend(x() is not None for x in before)
            before.clear()
            rows, label, weight = pieces[k]()
            sizes.append(sum(x.nbytes for x in rows))
            before.append(weakref.ref(label))
            return rows, label, weight

        return fit([lambda k=k: read(k) for k in range(len(pieces))], *args, **kwargs)

    monkeypatch.setattr(ftrl, "fit_pieces", watched)
    toxicity.train(docs, marks, piece=20_000)
    assert len(sizes) > 8 and max(sizes) <= 20_000 and not any(left)
