"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

Texts are reduced to their words (runs of ASCII letters and digits and of all characters from U+0080; A-Z lower-cased),
joined by one space. A rule is a regular expression over this form with a keyword, a priority and a confidence. A rule
runs on a text only if the text holds its keyword. Of the detections, one that lies within the interval of a detection
that comes before it (by the rules' order, which is by priority; then length, then start) is dropped. The labels that are left, and those of the base
phrases, which always stay, are the text's labels. The score is the best confidence among them, 0 without any.

All of it is Spark column expressions on each row: no Python on executors, no shuffle. Null or empty text: no words, no
labels, score 0. Nulls in other columns, repeated rows and ties (equal priority: the earlier rule)
change nothing else. Empty table: empty result. Columns of the input that clash with an output column are replaced.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import blocks, let, places

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
_L = "licen[cs]e"

#: label -> (priority, keywords one of which the name holds, regular expression of the name in normal form).
NAMES = {
    "mit": (10, ["mit", "expat", "x11"], "(?:mit|expat|x11)"),
    "mit-0": (30, ["mit"], "mit (?:no attribution|0)"),
    "apache-1.1": (30, ["apache"], rf"apache (?:software )?(?:{_L} )?(?:version |v)?1 1"),
    "apache-2": (30, ["apache"], rf"apache (?:software )?(?:{_L} )?(?:version |v)?2(?: 0)?"),
    "apache": (10, ["apache"], "apache(?: software)?"),
    "bsd": (10, ["bsd"], "bsd"),
    "bsd-2-clause": (30, ["bsd"], "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": (30, ["bsd"], "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": (30, ["bsd"], "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "0bsd": (40, ["bsd"], "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "isc": (20, ["isc"], "isc"),
    "gpl": (10, ["gpl", "general public"], rf"(?:gnu )?(?:gpl|general public {_L})"),
    "gpl-1": (30, ["gpl", "general public"], rf"(?:gnu )?(?:gpl|general public {_L})(?: gpl)? ?(?:version |v)?1(?: 0)?"),
    "gpl-2": (30, ["gpl", "general public"], rf"(?:gnu )?(?:gpl|general public {_L})(?: gpl)? ?(?:version |v)?2(?: 0)?"),
    "gpl-3": (30, ["gpl", "general public"], rf"(?:gnu )?(?:gpl|general public {_L})(?: gpl)? ?(?:version |v)?3(?: 0)?"),
    "lgpl": (20, ["lgpl", "general public"], rf"(?:lgpl|(?:gnu )?(?:lesser|library) general public {_L})"),
    "lgpl-2.1": (40, ["lgpl", "general public"], rf"(?:lgpl|(?:gnu )?(?:lesser|library) general public {_L})(?: lgpl)? ?(?:version |v)?2(?: 1)?"),
    "lgpl-3": (40, ["lgpl", "general public"], rf"(?:lgpl|(?:gnu )?lesser general public {_L})(?: lgpl)? ?(?:version |v)?3(?: 0)?"),
    "agpl": (20, ["agpl", "affero"], rf"(?:agpl|(?:gnu )?affero general public {_L})"),
    "agpl-3": (40, ["agpl", "affero"], rf"(?:agpl|(?:gnu )?affero general public {_L})(?: agpl)? ?(?:version |v)?3(?: 0)?"),
    "gfdl": (30, ["gfdl", "free documentation"], rf"(?:gfdl|(?:gnu )?free documentation {_L})"),
    "mpl": (20, ["mpl", "mozilla"], rf"(?:mpl|mozilla public {_L})"),
    "mpl-1.1": (30, ["mpl", "mozilla"], rf"(?:mpl|mozilla public {_L})(?: mpl)? ?(?:version |v)?1 1"),
    "mpl-2": (30, ["mpl", "mozilla"], rf"(?:mpl|mozilla public {_L})(?: mpl)? ?(?:version |v)?2(?: 0)?"),
    "epl-1": (30, ["epl", "eclipse"], rf"(?:epl|eclipse public {_L}) ?(?:version |v)?1(?: 0)?"),
    "epl-2": (30, ["epl", "eclipse"], rf"(?:epl|eclipse public {_L}) ?(?:version |v)?2(?: 0)?"),
    "cddl": (30, ["cddl", "development and"], rf"(?:cddl|common development and distribution {_L})"),
    "cpl": (30, ["common public"], rf"common public {_L}"),
    "eupl": (30, ["eupl", "union public"], rf"(?:eupl|european union public {_L})"),
    "osl-3": (30, ["open software"], rf"open software {_L}(?: (?:version |v)?3(?: 0)?)?"),
    "afl-3": (30, ["academic free"], rf"academic free {_L}(?: (?:version |v)?3(?: 0)?)?"),
    "artistic": (20, ["artistic"], "(?:perl )?artistic"),
    "artistic-2": (30, ["artistic"], rf"(?:perl )?artistic(?: {_L})? (?:version |v)?2(?: 0)?"),
    "boost-1": (30, ["bsl", "boost"], rf"(?:bsl 1 0|boost software(?: {_L})?(?: (?:version |v)?1(?: 0)?)?)"),
    "busl-1.1": (30, ["busl", "business source"], rf"(?:busl|business source {_L})(?: (?:version |v)?1 1)?"),
    "sspl-1": (30, ["sspl", "server side"], rf"(?:sspl|server side public {_L})(?: (?:version |v)?1)?"),
    "elastic-2": (30, ["elastic"], rf"elastic {_L}(?: (?:version |v)?2(?: 0)?)?"),
    "zlib": (20, ["zlib"], "zlib(?: libpng)?"),
    "libpng": (20, ["libpng"], "libpng"),
    "python-2": (30, ["psf", "python software"], rf"(?:psf|python software foundation)(?: {_L})?(?: (?:version |v)?2)?"),
    "postgresql": (20, ["postgresql"], "postgresql"),
    "ruby": (20, ["ruby"], "ruby"),
    "php-3": (30, ["php"], rf"php {_L}(?: (?:version |v)?3(?: 01?)?)?"),
    "openssl": (20, ["openssl"], "openssl"),
    "ofl-1.1": (30, ["ofl", "open font"], rf"(?:sil )?(?:ofl|open font {_L})(?: (?:version |v)?1 1)?"),
    "ms-pl": (30, ["microsoft public"], rf"microsoft public {_L}"),
    "ms-rl": (30, ["microsoft reciprocal"], rf"microsoft reciprocal {_L}"),
    "wtfpl": (30, ["wtfpl"], "wtfpl"),
    "unlicense": (30, ["unlicense"], "unlicense"),
    "public-domain": (20, ["public domain"], "public domain"),
    "cc0-1": (40, ["cc0", "cc zero", "creative commons"], "(?:cc0|cc zero|creative commons zero)(?: 1 0)?"),
    "cc-by": (20, ["cc by", "creative commons"], "(?:cc by|creative commons attribution)(?: [1-4] 0)?"),
    "cc-by-sa": (30, ["cc by", "creative commons"], "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?"),
    "cc-by-nd": (30, ["cc by", "creative commons"], "(?:cc by nd|creative commons attribution no ?deriv(?:s|ative|atives))(?: [1-4] 0)?"),
    "cc-by-nc": (30, ["cc by", "creative commons"], "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?"),
    "cc-by-nc-sa": (40, ["cc by", "creative commons"], "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?"),
    "cc-by-nc-nd": (40, ["cc by", "creative commons"], "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|ative|atives))(?: [1-4] 0)?"),
    "odbl": (30, ["odbl", "database"], rf"(?:odbl|open (?:data commons )?(?:open )?database {_L})"),
    "odc-by": (30, ["odc", "data commons"], "(?:odc by|open data commons attribution)"),
    "ogl-3": (30, ["open government"], rf"open government {_L}(?: (?:version |v)?3(?: 0)?)?"),
    "proprietary": (10, ["proprietary", "commercial", "end user"], rf"(?:proprietary|commercial|end user) {_L}(?: agreement)?"),
}
#: Words that, before "under" and a name, state a license without that word.
_GIVEN = "(?:released|distributed|published|available|provided|covered|shared|issued)(?: to you)?"
#: Forms in which a name is stated: (what is added to the priority, keyword, confidence, form). ``{}`` is the name.
FORMS = [
    (5, "licen", 0.95, rf"(?:re ?)?(?:licen[cs]ed|released|distributed|published|available|provided|covered|shared|issued)(?: to you)? under (?:the )?(?:terms of )?(?:the )?(?:terms of the )?{{}}(?: {_L})?"),
    (5, "under", 0.85, rf"{_GIVEN} under (?:the )?(?:terms of )?(?:the )?{{}}"),
    (4, "spdx", 1.0, rf"spdx {_L} identifier {{}}(?: only| or later)?"),
    (3, "licen", 0.9, rf"(?:governed by|subject to|see|read|accept|under|per) (?:the )?(?:terms of )?(?:the )?{{}} {_L}"),
    (2, "licen", 0.8, rf"{_L}s? (?:is |are |type |name )?(?:the )?{{}}(?: {_L})?"),
    (0, "licen", 0.7, rf"(?:the )?{{}} {_L}"),
]
#: Names that are a license without further words.
ALONE = ["gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "gfdl", "mpl-2", "apache-2", "cc0-1", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "odbl", "unlicense", "wtfpl", "eupl", "cddl"]
#: What a text must hold, in lower case, to be scanned at all.
GATE = ["licen", "spdx", "gpl", "gfdl", "mozilla", "odbl", "wtfpl", "eupl", "cddl", "apache", "permission", "copyright", "cc0", "commons", "reserved"]
GATE_CC = rf"(?i)cc[{_SEP}]+(?:by|zero)"
#: Any separators may stand between words.
GATE_DOMAIN = rf"(?i)public[{_SEP}]+domain"
GATE_UNDER = rf"(?i){_GIVEN} under ".replace(" ", rf"[{_SEP}]+")
#: Where a word starts: many words hold these letters.
GATE_MPL = r"(?i)(?<![0-9A-Za-z\x{80}-\x{10FFFF}])mpl"
#: Rules on wording rather than names: (priority, keyword, confidence, label, expression).
WORDING = [
    (50, "permission", 0.95, "mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    (50, "permission", 0.9, "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    (50, "licen", 0.9, "bsd", "redistribution and use in source and binary forms with or without modification"),
    (45, "copyright", 0.6, "copyright", "(?:copyright|all rights reserved)(?: c)? (?:19|20)[0-9]{2}"),
    (45, "all rights", 0.6, "copyright", "all rights reserved(?: c)? (?:19|20)[0-9]{2}"),
    (15, "public domain", 0.7, "public-domain", "(?:dedicated to|in|into) the public domain"),
    (5, "licen", 0.4, "unknown", rf"(?:licen[cs]ed under|under the (?:terms|following) {_L}|{_L} agreement|terms of (?:the|this) {_L})"),
]


def rules() -> list[tuple[int, str, list[str], float, str, str]]:
    """All rules as (priority, keyword, further keywords one of which is needed too, confidence, label, expression), in order."""
    out = [(p, key, [key], sure, label, x) for p, key, sure, label, x in WORDING]
    for label, (priority, keys, name) in NAMES.items():
        out += [(priority + more, key, keys, sure, label, form.replace("{}", name)) for more, key, sure, form in FORMS]
        out += [(priority - 1, "", keys, 0.6, label, name)] * (label in ALONE)
    return sorted(out, key=lambda r: -r[0])


def keywords() -> list[str]:
    return sorted({k for r in rules() for k in (r[1], *r[2])})


def gated(text: Column) -> Column:
    """Whether the text may hold anything that a rule or a base phrase finds."""
    low = F.lower(text)
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in GATE])
    held = held | (F.contains(low, F.lit("public")) & text.rlike(GATE_DOMAIN)) | (F.contains(low, F.lit("under")) & text.rlike(GATE_UNDER))
    return held | (F.contains(low, F.lit("cc")) & text.rlike(GATE_CC)) | (F.contains(low, F.lit("mpl")) & text.rlike(GATE_MPL))


def _bounded(expression: str) -> str:
    return rf"(?<![^ ]){expression}(?![^ ])"


def normal_form(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(text, upper, lower), rf"[{_SEP}]+", " "))


def _table(rows: list[tuple]) -> Column:
    """The rules as one constant array, in their order; as JSON, since thousands of literals take the driver long."""
    made = [{"rank": i, "keyword": key, "keywords": keys, "sure": sure, "label": label, "pattern": _bounded(x)} for i, (_, key, keys, sure, label, x) in enumerate(rows)]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<rank:int,keyword:string,keywords:array<string>,sure:double,label:string,pattern:string>>")


_PLACED = "array<struct<word:bigint,start:int,end:int,label:string>>"
_DETECTION = "array<struct<rank:int,shorter:int,start:int,end:int,label:string,sure:double>>"


def _base(norm: Column, phrase: str, label: str) -> Column:
    pattern = F.lit(_bounded(phrase))
    spaces = lambda x: F.length(F.regexp_replace(x, "[^ ]+", ""))
    place = lambda m, w: F.struct(w["start"].cast("long").alias("word"), m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label"))
    return let(places(norm, pattern), lambda found: F.when(F.size(found) > 0, F.zip_with(found, places(norm, pattern, spaces), place)).otherwise(F.array().cast(_PLACED)))


def _detections(norm: Column, table: Column) -> Column:
    """Detections of the rules whose keyword ``norm`` holds, without those inside one of a rule before.

    Detections are walked by place, block by block, with those that still reach on: linear in their number.
    """

    def detect(r: Column) -> Column:
        return F.transform(places(norm, r["pattern"]), lambda m: F.struct(r["rank"].alias("rank"), (m["start"] - m["end"]).alias("shorter"), m["start"].alias("start"), m["end"].alias("end"), r["label"].alias("label"), r["sure"].alias("sure")))

    def keep(acc: Column, d: Column) -> Column:
        # by start, the longer first: what may hold d is among those that reach beyond its start
        still = F.filter(acc["open"], lambda k: k["end"] > d["start"])
        inside = F.exists(still, lambda k: (k["rank"] <= d["rank"]) & (k["end"] >= d["end"]))
        return F.when(inside, acc).otherwise(F.struct(F.concat(still, F.array(d)).alias("open"), F.concat(acc["out"], F.array(d)).alias("out")))

    def across(acc: Column, block: Column) -> Column:
        made = F.aggregate(block, F.struct(acc["open"].alias("open"), none.alias("out")), keep)
        return let(made, lambda m: F.struct(m["open"].alias("open"), F.concat(acc["parts"], F.array(m["out"])).alias("parts")))

    none = F.array().cast(_DETECTION)
    by_place = lambda hits: F.array_sort(F.transform(hits, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["rank"].alias("rank"), d["shorter"].alias("shorter"), d["end"].alias("end"), d["label"].alias("label"), d["sure"].alias("sure"))))
    as_found = lambda hits: F.transform(by_place(hits), lambda d: F.struct(*[d[k].alias(k) for k in ("rank", "shorter", "start", "end", "label", "sure")]))
    left = lambda found: F.array_sort(F.aggregate(blocks(found), F.struct(none.alias("open"), F.array().cast(f"array<{_DETECTION}>").alias("parts")), across, lambda acc: F.flatten(acc["parts"])))
    held = F.filter(F.array(*[F.lit(k) for k in keywords()]), lambda k: F.contains(norm, k))
    hits = let(held, lambda keys: F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(keys, r["keyword"]) & F.arrays_overlap(keys, r["keywords"])), detect)))
    return let(let(hits, as_found), left)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, base (array of word, start, end, label) and detections (those kept)."""
    table = _table(rules())
    text = F.coalesce(F.col(text_col), F.lit(""))

    def read(norm: Column) -> Column:
        return F.struct(F.array_sort(F.concat(*[_base(norm, p, k) for p, k in BASE.items()])).alias("base"), _detections(norm, table).alias("detections"))

    none = F.struct(F.array().cast(_PLACED).alias("base"), F.array().cast(_DETECTION).alias("detections"))
    made = F.when(gated(text), let(normal_form(text), read)).otherwise(none)
    own = [docs[c] for c in docs.columns if c == text_col or c not in ("n_words", "base", "detections")]
    # inline() makes the one row again, with what was found computed once
    return docs.select(*own, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.inline(F.array(made)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and score."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    own, made = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    words = F.transform("base", lambda b: b["word"])
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(own, made))), ",").alias("labels"), score.alias("score"))
