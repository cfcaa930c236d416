"""Fill-in-the-middle: texts cut at random units and put together in another order, with the cuts found by joins.

A text's units are the matches of a pattern that tile it (code points, words, lines). Each text is exploded into its units
with their ordinals; window sums over a text give how many units and code points stand before each; two cut requests a text
are joined to them by ordinal; their offsets are grouped back to the text, which is then cut by ``substring``. Only numbers
are exploded, windowed and joined; the texts are shuffled once, to meet their offsets. Since all code points are one long,
``RUN`` of them in a row make one row of the unit table.

Rows are told apart by two 64-bit hashes of id and text; equal rows are one in the unit table and each get the result. So
nothing is gathered but the units of one text. Null text: empty, so plain. Null id: hashed as an empty id. Empty table:
empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points that are one row of the unit table; only the number of rows depends on it.
RUN = 2048
CHARS, WORDS, LINES = "(?s).", r"\s*\S+\s*|\s+", "(?s)[^\n]*\n|[^\n]+$"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_KEY = ["key_1", "key_2", "id"]


def draws(id_: Column, n: int = 4, seed: int = 1) -> list[Column]:
    """The first ``n`` 8-digit groups of the sha256 of seed and id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.withColumns({"key_1": F.xxhash64("id", "text"), "key_2": F.xxhash64("text", F.lit(1), "id")})


def units(rows: DataFrame, unit: str = CHARS) -> DataFrame:
    """(key, ordinal, n, chars, n_before, chars_before, n_all) of the units of each distinct row; runs of code points count
    ``n`` units. A text without a match has none."""
    run = RUN if unit == CHARS else 1
    matches = F.regexp_extract_all("text", F.lit(f"{CHARS}{{1,{RUN}}}" if unit == CHARS else unit), F.lit(0))
    each = rows.select(*_KEY, F.posexplode(F.transform(matches, F.length)).alias("ordinal", "chars"))
    once = each.groupBy(*_KEY, "ordinal").agg(F.max("chars").alias("chars")).withColumn("n", F.col("chars") if run > 1 else F.lit(1))
    whole = Window.partitionBy(*_KEY)
    before = whole.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "chars")}
    return once.withColumns({**sums, "n_all": F.sum("n").over(whole)})


def cuts(placed: DataFrame, unit: str = CHARS) -> DataFrame:
    """(key, n, prefix_end, middle_end): units of each text, and the offsets of its two cuts in code points."""
    h1, h2 = draws(F.col("id"), 2)
    several = F.col("n") + 1
    asked = F.array(F.struct(F.lit(0).alias("which"), F.least(h1 % several, h2 % several).alias("cut")), F.struct(F.lit(1).alias("which"), F.greatest(h1 % several, h2 % several).alias("cut")))
    requests = placed.groupBy(*_KEY).agg(F.max("n_all").alias("n")).select(*_KEY, "n", F.inline(asked))
    # a cut stands in, or at the end of, the row of the last unit before it
    ordinal = F.floor(F.greatest(F.col("cut") - 1, F.lit(0)) / (RUN if unit == CHARS else 1)).cast("int")
    met = requests.withColumn("ordinal", ordinal).join(placed.select(*_KEY, "ordinal", F.col("n").alias("here"), "chars", "n_before", "chars_before"), [*_KEY, "ordinal"])
    offset = F.col("chars_before") + F.expr("(cut - n_before) * chars DIV here")
    return met.groupBy(*_KEY).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("which") == i, offset)).cast("int").alias(x) for i, x in enumerate(("prefix_end", "middle_end"))])


def _restored(form: Column, out: Column) -> Column:
    """The text that an output of a form was made of."""
    at = lambda mark: F.instr(out, mark)
    cut = lambda a, b: F.substring(out, a, b)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    psm = F.concat(cut(p + 3, s - p - 3), cut(m + 3, F.length(out)), cut(s + 3, m - s - 3))
    spm = F.concat(cut(p + 3, m - p - 3), cut(m + 3, F.length(out)), cut(s + 3, p - s - 3))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def fill_in_middle(docs: DataFrame, unit: str = CHARS, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of each row of ``docs``.

    ``percent`` of the texts are cut, ``spm_percent`` of those have the suffix first; the others, empty ones and those that
    hold a mark stay plain. ``restored`` is the text made of output and form again.
    """
    rows = keyed(docs, id_col, text_col)
    found = cuts(units(rows, unit), unit)
    text, a, b = F.col("text"), F.col("prefix_end"), F.col("middle_end")
    _, _, h3, h4 = draws(F.col("id"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((F.length(text) == 0) | a.isNull() | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    out = rows.join(found, _KEY, "left").withColumn("form", form)
    is_ = F.col("form")
    made = F.when(is_ == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(is_ == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    cut = lambda x: F.when(is_ != "plain", x).cast("long")
    out = out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "form", cut(a).alias("prefix_chars"), cut(b - a).alias("middle_chars"), made.alias("output"))
    return out.withColumn("restored", _restored(is_, F.col("output")))


def digest(docs: DataFrame) -> DataFrame:
    found = fill_in_middle(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
