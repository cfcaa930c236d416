"""The operators' exact contracts against plain versions, on whole tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barlake.llm import frames, jpeg, licenses, line_rules, minhash, packing, pii, queries, url_filter
from tests.llm import brute
from tests.llm.conftest import SF


def test_near_duplicates(docs, rows, none):
    once = {}
    for i, t in rows:
        once.setdefault(i, []).append(t)
    plain = brute.near_duplicates([(i, ts[0]) for i, ts in once.items() if i is not None and len(ts) == 1])
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    for i, (n, component) in plain.items():
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (n, component, i == component), i
    assert found[None].component_id is None and found[None].kept
    assert minhash.near_duplicates(none).count() == 0


def test_groups_of_near_copies(spark):
    """A chain of near copies is one group; texts that share half their words stay apart."""
    base = [f"w{i}" for i in range(200)]
    made = [(k, " ".join(base[: 200 - k] + [f"n{k}x{j}" for j in range(k)])) for k in range(0, 120, 4)]
    made += [(1000 + k, " ".join(base[:100] + [f"o{k}x{j}" for j in range(100)])) for k in range(300)]
    made += [(2000 + k, "the same text for all of these many copies") for k in range(500)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert found == brute.near_duplicates(made)


def test_licenses(docs, rows, none):
    plain = Counter((i, *brute.licenses(t)) for i, t in rows)
    found = licenses.digest(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == plain
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.digest(none).count() == 0


def test_license_rules(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0": "apache-2", "This is free software under the GNU General Public License version 3": "gpl-3",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "GNU Lesser General Public License v2.1": "lgpl-2.1", "licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa", "nothing here": "",
    }
    found = {r.text: r.labels for r in licenses.digest(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).select(F.col("doc_id").alias("text"), "labels").collect()}
    for t, label in texts.items():
        assert label in found[t].split(","), (t, found[t])


def test_lines(docs, rows, none):
    plain = Counter((i, *brute.lines(t)) for i, t in rows)
    found = line_rules.clean_lines(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == plain
    assert not any(r.kept for r in found if r.base_failed)
    assert line_rules.clean_lines(none).count() == 0


def test_personal_data(docs, rows, none):
    plain = Counter()
    for i, t in rows:
        spans = brute.personal(t)
        n = Counter(k for _, _, k, _ in spans)
        plain[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()] += 1
    found = pii.digest(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == plain
    assert "iban:5:32" in next(r.spans for r in found if r.doc_id == 900013)
    assert pii.digest(none).count() == 0


def test_redaction(docs, rows):
    for r in pii.redact(pii.find_pii(docs.select("doc_id", "text"))).collect():
        assert r.text is None or not [s for s in brute.personal(r.text) if s[2] == "email"]


def test_pages(spark):
    odd = spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "no scheme", "<a>"), (-4, "HTTP://Example.COM/en/7x?q#f", None), (-5, "http://a.example.net/de/8", None), (-6, "x://h?://y/z", None), (None, "https://notcom/en/", "x" * 200_000)], "page_id long, url string, html string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").union(odd).withColumn("host", F.lit("clash"))
    plain = {r.page_id: brute.url(r.url) for r in pages.collect()}
    found = url_filter.judge(pages).collect()
    assert len(found) == len(plain)
    for r in found:
        host, path, rule, verdict = plain[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert {r.verdict for r in found if r.rule is None} == {"allow", "block"}  # the graph decides some either way
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_packing(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    plain = Counter()
    for (i, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        plain[i, tuple([*e.ids, 1])] += 1
    pieces = packing.pack(docs).collect()
    lengths = Counter()
    for (i, ids), n in plain.items():
        lengths[i] += n * len(ids)
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == lengths
    for p in pieces:
        fits = [ids for i, ids in plain if i == p.doc_id and len(ids) == p.doc_tokens]
        assert any(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length])) == p.ids_crc32 for ids in fits)
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append(p)
    total = padded = 0
    for held in bins.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded <= 1.05 * total + 8 * 2048
    assert packing.pack(none).count() == 0


def test_tokens_of_mixed_scripts(spark):
    """Ids by runs are those of whole texts: contractions, cases, combining marks, scripts, digits, odd spaces, special tokens; also after the table was halved."""
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole, draw = Tokenizer.from_file(path), random.Random(4)
    pool = ["it's", "DON'T", "we've", "l'été", "ÀÉÎ", "straße", "ΣΑΣ", "σας", "İstanbul", "ı", "e\u0301", "日本語", "1234", "²½", "a1b2", "--'s", "'", "<|startoftext|>", "<|", "😀", "\x85", "\x1c", "\x00", "\u200b", "ǅ", "ﬁ", "\xa0", "\u3000", "x\xady", "I'LL", "word", "wörter"]
    texts = ["".join(draw.choice(pool) + draw.choice(["", " ", "\n", "\t"]) for _ in range(30)) for _ in range(600)] + ["", None, " \n"]
    tokens = packing.Tokens(path)
    expected = [[*whole.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]
    for part in (slice(0, 300), slice(300, None), slice(0, 50)):
        assert [a.tolist() for a in tokens.of([t or "" for t in texts[part]])] == expected[part]
        tokens._forget()


def test_rows_that_repeat_an_id(spark):
    """An id's texts count as one document: it joins what is near to any of them."""
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    made = [(5, a), (5, b), (6, b + " more"), (7, a + " more"), (5, a), (8, "something else that stands alone here"), (9, None), (None, a)]
    for turn in (made, made[::-1]):
        found = minhash.near_duplicates(spark.createDataFrame(turn, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == sorted([(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (8, 8, True), (9, 9, True), (0, 0, True)])


def test_jpeg(docs, rows, none):
    plain = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        plain[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    found = jpeg.digest(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == plain
    by_payload = defaultdict(set)
    for r in found:
        by_payload[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert jpeg.digest(none).count() == 0


def test_very_long_texts(spark):
    long_ = ["x" * 1_000_000, "7" * 1_000_000, "+7 " * 100_000, "a@b.c " * 5_000, "1.2.3.4 " * 5_000]
    df = spark.createDataFrame(list(enumerate(long_)), "doc_id long, text string")
    assert pii.digest(df).count() == licenses.digest(df).count() == len(long_)


def test_every_query_runs(spark):
    for name, query in queries.queries().items():
        assert query(spark, SF).count() > 0, name


def test_pairs_in_a_family_just_under_the_bound(spark):
    """20 pairs of similarity 0.76, spread over a family of texts that share a passage and are 0.74 similar: all are found, nothing else."""
    passage = [f"p{i}" for i in range(174)]  # 170 shingles of 200
    texts = {i: passage + [f"u{i}x{j}" for j in range(30)] for i in range(2000)}
    pairs = {100 + 37 * k: 1000 + 41 * k for k in range(20)}
    for a, b in pairs.items():
        for i in (a, b):
            texts[i] = passage + [f"both{a}x{j}" for j in range(3)] + [f"u{i}x{j}" for j in range(27)]
    made = [(i, " ".join(t)) for i, t in texts.items()]
    sets = {i: brute.shingle_set(t) for i, t in made}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(alike(a, b) >= 0.75 for a, b in pairs.items()) and all(0.73 < alike(0, i) < 0.75 for i in range(1, 2000))
    found = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).where("NOT kept").collect()
    assert {r.component_id: r.doc_id for r in found} == pairs


def _example(tree, draw):
    """A text that the parsed regular expression fits, optional and alternative parts drawn."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[0]
            out += chr(value[0] if str(kind) == "RANGE" else value)
        elif name == "BRANCH":
            out += _example(draw.choice(arg[1]), draw)
        elif name == "SUBPATTERN":
            out += _example(arg[3], draw)
        elif name == "MAX_REPEAT":
            out += "".join(_example(arg[2], draw) for _ in range(draw.choice([arg[0], min(arg[1], max(arg[0], 1))])))
        else:
            raise AssertionError(name)
    return out


def test_license_gate(spark):
    """Examples of every rule that holds its keywords pass the gate, whatever separates the words; names after 'under' are found."""
    draw = random.Random(1)
    made = []
    for _, key, keys, _, label, x in licenses.rules():
        for _ in range(6):
            plain = _example(re._parser.parse(x), draw)
            if key in plain and any(k in plain for k in keys):
                made.append((label, "".join(draw.choice([" ", "-", "\n ", ", "]) if c == " " else c for c in plain)))
    assert {m[0] for m in made} >= set(licenses.NAMES)
    lost = spark.createDataFrame(made, "label string, text string").where(~licenses.gated(F.col("text"))).collect()
    assert not lost, lost[:5]
    texts = {
        "Released under MIT": "mit", "published under BSD-3-Clause": "bsd-3-clause", "available under EPL 2.0": "epl-2", "distributed under zlib": "zlib", "provided under Boost Software 1.0": "boost-1",
        "given into the public-domain": "public-domain", "given into the public\ndomain": "public-domain", "All rights reserved 2020": "copyright",
    }
    found = {r.doc_id: r.labels.split(",") for r in licenses.digest(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).collect()}
    for t, label in texts.items():
        assert label in found[t], (t, found[t])


def test_long_chain_of_hosts(spark):
    """A host 30 links away from the only blocked one, and from no allowed one, is blocked as well."""
    chain = [(i, f"http://h{i}.test/", f'<a href="http://h{i + 1}.test/">') for i in range(30)] + [(30, "http://h30.test/", '<a href="http://bad.org/">'), (31, "http://bad.org/es/1", ""), (32, "http://alone.test/", "")]
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()}
    assert all(found[i].verdict == "block" and found[i].distrust > 0 for i in range(32)) and found[32].verdict == "allow"


def test_long_secrets(spark):
    """A run of any length is one secret."""
    made = [(n, "the api token is " + "aB3_" * n + " .") for n in (8, 32, 33, 5000)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.digest(docs).collect()} == {n: f"secret:17:{17 + 4 * n}" for n, _ in made}
    assert {r.text for r in pii.redact(pii.find_pii(docs)).collect()} == {"the api token is [SECRET] ."}


def test_broken_media(spark):
    """Null and broken files give nulls, clashing columns are replaced, whole files are read."""
    whole = jpeg.encode(bytes(range(64)))
    made = [(1, whole, "x"), (2, None, "x"), (3, b"", "x"), (4, b"no image", "x"), (5, whole[:-40], "x"), (6, whole[:200], "x"), (7, b"\xff\xd8\xff\xd9", "x")]
    found = jpeg.read(spark.createDataFrame(made, "doc_id long, media binary, height string")).collect()
    assert {r.doc_id: r.payload and bytes(r.payload) for r in found} == {1: bytes(range(64)), **dict.fromkeys(range(2, 8))}
    assert all((r.height is None) == (r.doc_id > 1) for r in found)


def test_lines_kept(docs, rows):
    """Which documents and lines stay, against a plain version over all rows."""
    plain = Counter((i, *brute.lines_kept(t, line_rules.bad_line)) for i, t in rows if len(t or "") < 50_000)
    found = line_rules.clean_lines(docs).where("coalesce(length(text), 0) < 50000").collect()
    assert Counter((r.doc_id, r.kept, r.cleaned) for r in found) == plain


@pytest.mark.parametrize(("line", "bad"), [
    ("Start | Produkte | Über uns | Kontakt", True), ("Inicio > Cámaras > Lentes", True), ("one • two • three", True), ("either / or is a choice that all of the readers have to make", False), ("a > b", False),
    ("Tous droits réservés.", True), ("© Example 2021", True), ("Copyright (c) 2019 the authors", True), ("the copyright of 2019 was a matter that the court took up again", True),
    ("https://a.example/x https://b.example/y", True), ("see https://a.example/x for what the rest of it says", False), ("write to a@b.example", False), ("#### $$$$ ****", True), ("A plain sentence, with a comma & more.", False), ("x", False),
])
def test_bad_lines(line, bad):
    assert line_rules.bad_line(line) == bad


def test_ranks_of_hosts(spark):
    """Trust and distrust of every host against plain ranks, within what the stated tolerance allows."""
    draw = random.Random(3)
    edges = Counter((f"h{draw.randrange(40)}", f"h{draw.randrange(40)}") for _ in range(160))
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    trust, distrust = {"h1": 0.5, "h2": 0.5}, {"h3": 0.25, "h4": 0.75}
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in {*trust, *distrust}], "host string, trust double, distrust double")
    found = url_filter.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), seeds, frames.Scratch(spark, "ranks")).collect()
    plain = brute.ranks(edges, trust), brute.ranks({(b, a): n for (a, b), n in edges.items()}, distrust)
    for r in found:
        for made, exact in ((r.trust, plain[0].get(r.host, 0.0)), (r.distrust, plain[1].get(r.host, 0.0))):
            assert made == pytest.approx(exact, rel=2e-3)
    assert {r.host for r in found} == {h for p in plain for h, x in p.items() if x > 0}


def test_many_matches_in_one_text(spark):
    """Places of 20,000 matches, over many blocks, are those of a plain search; context reaches over matches close by."""
    text = "a@b.co é 1.2.3.4 " * 20_000
    found = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute.personal(text))
    assert (found.n_email, found.n_ip, found.base_sha256) == (20_000, 20_000, hashlib.sha256(spans.encode()).hexdigest())
    phrase = "so Under the MIT license; " * 3_000
    r = licenses.digest(spark.createDataFrame([(1, phrase)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(phrase)
    near = "passport no 😀 12345678 12345679 " + "x" * 60 + " 12345670"
    assert pii.digest(spark.createDataFrame([(1, near)], "doc_id long, text string")).first().spans == "id:14:22,id:23:31"


def test_many_detections_in_one_text(spark):
    """Tens of thousands of detections: the same labels as a few, in time linear in their number; rules inside others go."""
    line = "licensed under the apache license version 2 0 and under the mit license ; "
    few, many = (licenses.scan(spark.createDataFrame([(1, line * n)], "doc_id long, text string")).first() for n in (3, 8_000))
    assert {d.label for d in few.detections} == {d.label for d in many.detections} and len(many.detections) == len(few.detections) // 3 * 8_000
    for a in few.detections:
        assert not any(b is not a and b.rank < a.rank and b.start <= a.start and b.end >= a.end for b in few.detections)


def test_many_spans_redacted(spark):
    text = "mail a@b.co now é, " * 6_000
    found = pii.redact(pii.find_pii(spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "")], "doc_id long, text string"))).collect()
    assert {r.doc_id: r.text for r in found} == {1: "mail [EMAIL] now é, " * 6_000, 2: "none", 3: None, 4: ""}
