"""Personal data: regular expressions propose spans, checks confirm them, words nearby adjust the score.

Everything is Spark column expressions; no Python runs on the executors. Each row is judged by itself, so there is no
shuffle. Regular expressions use possessive repeats and start only where a run of their characters starts (or where the
match before ended, ``\\G``), so that a run of a million digits costs linear time and no stack.

Kinds with fixed meaning (*base*, always reported once their check holds): email, ip, card (Luhn), phone.
Further kinds are reported if prior + check + context reaches ``THRESHOLD``: iban (mod 97), ssn, secret, id (a number
of 8 to 11 digits that context words call an account or passport number).

Null or empty text: no spans. Nulls in other columns, repeated rows and ties change nothing. Empty table: empty result.
Columns of the input that clash with an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import blocks, let, places

THRESHOLD, NEAR = 0.6, 40

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (cheap gate, pattern); the order is that of spans with the same start.
BASE = {
    "email": ("@[A-Za-z0-9-]", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){11}", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: kind -> (gate, pattern, prior, words nearby, what they add).
EXTRA = {
    "iban": (r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.3, r"iban|bank|konto|cuenta|compte|account", 0.3),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, r"ssn|social security|sozialversicherung|tax id", 0.4),
    "secret": (r"[A-Za-z0-9_/+-]{20}", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+(?![A-Za-z0-9_/+-])", 0.2, r"token|secret|passw|api.?key|credential|bearer|private.?key", 0.6),
    "id": (r"[0-9]{8}", r"(?<![0-9A-Za-z.+-])[0-9]{8,11}(?![0-9A-Za-z-])", 0.2, r"passport|account n|customer n|insurance n|national id|driver.?s? licen", 0.6),
}
KINDS = [*BASE, *EXTRA]


def around(text: Column, pattern: str) -> Column:
    """For every match of ``pattern`` the ``NEAR`` code points before and after it, lower-cased, as an array."""
    # the match itself is looked for first: looking back at every character would take 40 times as long
    wide = rf"(?={pattern})(?<=((?s:.){{{NEAR}}}|\A(?s:.){{0,{NEAR - 1}}})){pattern}(?=((?s:.){{0,{NEAR}}}))"
    sides = [F.regexp_extract_all(text, F.lit(wide), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*sides, lambda a, b: F.lower(F.concat(a, F.lit(" "), b)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number, without spaces, leaves 1 when divided by 97 (letters count 10 to 35)."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: c), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def small_part(x: Column) -> Column:
    """Whether a run of digits is at most 255, whatever its leading zeros."""
    y = F.ltrim(x, F.lit("0"))
    return (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))


def confirmed(kind: str, x: Column) -> Column:
    """The base check of a match of ``kind``."""
    n = F.length(digits(x))
    if kind == "card":
        return n.between(12, 19) & luhn(digits(x))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), small_part)
    return F.lit(True)


def checked(kind: str, x: Column) -> Column:
    """What the check adds to the score of a further kind."""
    if kind == "iban":
        bare = F.replace(x, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34) & mod97(bare), 0.6).otherwise(-1.0)
    if kind == "ssn":
        return F.when(x.rlike("^(?:000|666|9)") | x.rlike("-00-|-0000$"), -1.0).otherwise(0.2)
    return F.lit(0.0)


def _spans(text: Column, kind: str, order: int) -> Column:
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    gate, pattern = (BASE | EXTRA)[kind][:2]

    def span(m: Column, score: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.least(F.lit(1.0), score).alias("score"))

    if kind in BASE:
        made = F.transform(F.filter(places(text, F.lit(pattern)), lambda m: confirmed(kind, m["found"])), lambda m: span(m, F.lit(1.0)))
    else:
        prior, near, adds = EXTRA[kind][2:]
        judged = lambda m, by: span(m, F.lit(prior) + checked(kind, m["found"]) + F.when(by.rlike(near), adds).otherwise(0.0))
        made = let(places(text, F.lit(pattern)), lambda found: F.when(F.size(found) > 0, F.zip_with(found, around(text, pattern), judged)).otherwise(empty))
        made = F.filter(made, lambda s: s["score"] >= THRESHOLD - 1e-9)
    return F.when(text.rlike(gate), made).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (start, rank, kind, end, score) by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array_sort(F.concat(*[_spans(text, k, i) for i, k in enumerate(KINDS)]))
    own = [docs[c] for c in docs.columns if c == text_col or c != "pii"]
    # inline() makes the one row again, with the spans computed once
    return docs.select(*own, F.inline(F.array(F.struct(found.alias("pii")))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` of ``find_pii`` with each span in ``text_col`` replaced by its kind, like ``[EMAIL]``; overlapping spans become one."""
    text = F.col(text_col)

    def within(acc: Column, s: Column) -> Column:
        """``part`` is the text from ``from`` on, as far as the block's spans reach."""
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["done"], F.substring(acc["part"], acc["at"] - acc["from"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["done"]).alias("done"), acc["from"].alias("from"), acc["part"].alias("part"))

    def across(acc: Column, block: Column) -> Column:
        reach = F.array_max(F.transform(block, lambda s: s["end"]))
        start = F.struct(acc["at"].alias("at"), F.lit("").alias("done"), acc["at"].alias("from"), F.substring(text, acc["at"] + 1, F.greatest(reach - acc["at"], F.lit(0))).alias("part"))
        return let(F.aggregate(block, start, within), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["parts"], F.array(m["done"])).alias("parts")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    made = F.aggregate(blocks(F.col("pii")), first, across, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size("pii") > 0, made).otherwise(text))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, and all spans as text."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
