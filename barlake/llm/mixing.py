"""Mixing by iterative proportional fitting: token weights are raked to source, language and topic marginals.

1. One pass over the texts gives each document its tokens (words) and a topic: the table's topic column, or, where it has
   none, the nearest of at most ``TOPICS`` groups of documents with like words: spherical k-means over hashed words, rare
   ones weighing more, fitted on all documents in at most ``TURNS`` rounds. Each task adds up its own documents; the counts
   of words and the sums of a round's groups reach the driver, ``TOPICS`` * ``DIMS`` numbers. Sums are of whole numbers, so
   that the topics do not depend on how the rows are dealt. Such topics are numbers as text, "0" to "7", and "-1" for texts
   without words; they carry no name.
2. Tokens are summed by cell (source, language, topic): partial sums, so a hot source costs one row a task and cell.
3. For each of the three in turn, every cell's weight is multiplied by its value's target over the value's sum, until no
   value is off by more than ``TOLERANCE`` of its target when its turn comes, or ``ROUNDS`` rounds are done (targets that
   cannot all be met at once). Targets are ``{column: {value: share}}``, or tempered: shares in proportion to
   tokens ** exponent. Values absent from given targets get share 0; shares of values absent from the data are dealt to
   the others; if none is in the data, an error is raised.
4. A document's rate is its cell's weight over its tokens. It is kept with probability min(1, c * rate), c such that the
   expected tokens kept are ``keep`` of all; the draw is a hash of its id, so a run again draws the same.

Cells and weights stay distributed; a turn is one partially aggregated sum and one join of the cells. Nulls in source,
language and topic are a value of their own. Null or empty text: no tokens; such a document has its cell's probability (1
where the cell has no tokens). Rows without an id draw by their text's hash; repeated rows draw alike, and each row is
judged by its own cell. Empty table: empty result. ``mix`` replaces columns of the input that clash with its own;
``sample`` returns the columns as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames, words

TOPICS, ROUNDS, TOLERANCE, KEEP, SEED = 8, 20, 0.001, 0.8, 17
#: Bits of a text's words, most rounds in which the topics are fitted, and parts of 1 in which lengths are added up.
DIMS, TURNS, PARTS = 1024, 20, 1 << 30
#: Exponents of the default targets: 1 leaves a marginal as it is, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 0.8}


def marks_of(found: list[bytes]) -> bytes:
    """``DIMS`` bits, set where one of the words hashes to."""
    bits = np.zeros(DIMS, np.uint8)
    if found:
        bits[((words.word_hashes(list(set(found))) >> np.uint64(40)) % np.uint64(DIMS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _bits(marks: list[bytes]) -> np.ndarray:
    """A row of zeros and ones for each of ``marks``."""
    return np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), DIMS // 8), axis=1).astype(np.float64)


def _likeness(bits: np.ndarray, scale: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of ``bits``, weighted by ``scale``, and ``centres``, rounded so that ties are ties in every batch; and one over
    the length of each weighted row, 0 for rows without any."""
    found = bits @ np.column_stack([(centres * scale).T, scale * scale])
    share = 1 / np.sqrt(np.where(found[:, -1] > 0, found[:, -1], np.inf))
    return np.round(found[:, :-1] * share[:, None], 9), share


def _sums(parts: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the bits of each group, one row a group and task; ``parts`` gives whole numbers to take the bits times, by group
    and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TOPICS, DIMS), np.int64)
        for b in batches:
            if b.num_rows:
                bits = _bits(b.column(0).to_pylist())
                sums += (parts(bits) @ bits).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["topic", "sums"])

    return run


def _added(marks: DataFrame, parts: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of all rows by group."""
    each = marks.mapInArrow(_sums(parts), "topic long, sums array<long>").select("topic", F.posexplode("sums").alias("at", "x"))
    out = np.zeros((TOPICS, DIMS), np.int64)
    for r in each.groupBy("topic", "at").agg(F.sum("x").alias("x")).collect():  # at most TOPICS * DIMS rows
        out[r.topic, r["at"]] = r.x
    return out


def fit_topics(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(scale, centres) of all ``rows`` (draw, marks), None without rows: rare bits weigh more; at most ``TOPICS`` directions by
    spherical k-means, far-apart rows first, equally far ones by ``draw``."""
    start = rows.agg(F.count("*").alias("n"), F.min(F.struct("draw", "marks")).alias("first")).first()
    if not start.n:
        return None
    marks, group = rows.select("marks"), np.arange(TOPICS)[:, None]
    counts = _added(marks, lambda bits: np.repeat(group == 0, len(bits), axis=1).astype(np.float64))[0]
    scale = np.log((1 + start.n) / (1 + counts))

    def direction(mark: bytes) -> np.ndarray:
        bits = _bits([bytes(mark)])
        return bits * scale * _likeness(bits, scale, np.zeros((1, DIMS)))[1][:, None]

    centres = direction(start.first.marks)
    while len(centres) < TOPICS:
        known = centres

        @F.pandas_udf("double")
        def nearest(m: pd.Series) -> pd.Series:
            like, share = _likeness(_bits(list(m)), scale, known)
            return pd.Series(np.where(share > 0, like.max(axis=1), 1.0))  # words that all texts have show no direction

        far = rows.agg(F.min(F.struct(nearest("marks").alias("like"), "draw", "marks")).alias("x")).first().x
        if far.like >= 1:
            break
        centres = np.vstack([centres, direction(far.marks)])
    before = None
    for _ in range(TURNS):

        def parts(bits: np.ndarray, centres: np.ndarray = centres) -> np.ndarray:
            like, share = _likeness(bits, scale, centres)
            return np.where(like.argmax(axis=1) == group, np.rint(share * PARTS), 0.0)

        sums = _added(marks, parts)
        if before is not None and (sums == before).all():
            break
        before, own = sums, sums[: len(centres)] * scale
        length = np.linalg.norm(own, axis=1, keepdims=True)
        centres = np.where(length > 0, own / np.where(length > 0, length, 1.0), centres)
    return scale, centres


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [words.split(t, lower=True) for t in b.column("mix_text").to_pylist()]
        rest = [(b.column(k), k) for k in b.schema.names if k != "mix_text"]
        made = [(pa.array([len(f) for f in found], pa.int64()), "n_tokens"), (pa.array([marks_of(f) for f in found], pa.binary()), "marks")]
        yield pa.RecordBatch.from_arrays([c for c, _ in rest + made], [k for _, k in rest + made])


def measured(docs: DataFrame, scratch: frames.Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, source, lang, n_tokens, topic, own) of each row; ``own`` holds its columns, row_id is the id, or for rows
    without one a hash of the text."""
    frames.small_batches(docs.sparkSession)
    row = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("row_id")
    base = [row, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")]
    if "topic" in docs.columns:
        return docs.select(*base, F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("n_tokens"), F.col("topic").cast("string").alias("topic"))
    given = docs.select(*base, F.col(text_col).cast("string").alias("mix_text"))
    schema = T.StructType([f for f in given.schema if f.name != "mix_text"]).add("n_tokens", "long").add("marks", "binary")
    rows = scratch.write(given.mapInArrow(_measure, schema))
    drawn = scratch.write(rows.where("n_tokens > 0").select(F.xxhash64("row_id", F.lit(SEED)).alias("draw"), "marks"))
    fitted = fit_topics(drawn)
    scratch.free(drawn)
    if fitted is None:
        return rows.drop("marks").withColumn("topic", F.lit("-1"))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("string")
    def nearest(marks: pd.Series) -> pd.Series:
        return pd.Series(_likeness(_bits(list(marks)), *sent.value)[0].argmax(axis=1).astype(str) if len(marks) else [], dtype=str)

    return rows.withColumn("topic", F.when(F.col("n_tokens") > 0, nearest("marks")).otherwise("-1")).drop("marks")


def _targets(cells: DataFrame, column: str, given: dict | None) -> DataFrame:
    """(key, target): the share of all tokens that each value of ``column`` should have."""
    own = cells.where("tokens > 0").groupBy(F.col(f"key_{column}").alias("key"), F.col(column).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    if given is not None:
        pairs = F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(float(v)).alias("v")) for k, v in given.items()])
        own = own.withColumn("t", F.coalesce(F.element_at(F.map_from_entries(pairs), F.col("value")), F.lit(0.0)))
    else:
        own = own.withColumn("t", F.pow("t", F.lit(TEMPER[column])))
    total = own.agg(F.sum("t")).first()[0]
    if given is not None and not total and not cells.isEmpty():
        raise ValueError(f"no value of {column} in the data has a share among the targets {given}")
    return own.select(F.col("key").alias(f"key_{column}"), (F.col("t") / (total or 1.0)).alias(f"target_{column}"))


def rake(cells: DataFrame, scratch: frames.Scratch, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: tokens raked so that each marginal is as targeted, summing to 1."""
    keyed = cells.withColumns({f"key_{c}": F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in TEMPER})
    now = keyed.withColumns({"weight": F.col("tokens").cast("double"), "off": F.lit(0.0)})
    for c in TEMPER:
        now = now.join(_targets(keyed, c, (targets or {}).get(c)), f"key_{c}", "left")
    now = scratch.write(now)
    for _ in range(rounds):
        for i, c in enumerate(TEMPER):
            old = now
            sums = old.groupBy(f"key_{c}").agg(F.sum("weight").alias("sum"))
            goal = F.coalesce(f"target_{c}", F.lit(0.0))
            change = F.when(F.col("sum") > 0, goal / F.col("sum")).otherwise(0.0)
            off = F.when((F.col("sum") > 0) & (goal > 0), F.abs(F.col("sum") / goal - 1)).otherwise(0.0)
            turned = old.join(sums, f"key_{c}").withColumns({"off": F.greatest(F.lit(0.0) if i == 0 else F.col("off"), off), "weight": F.col("weight") * change})
            now = scratch.write(turned.select(*old.columns))
            scratch.free(old)
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return now.select(*cells.columns, "weight")


def scale(cells: DataFrame, keep: float) -> float:
    """c for which the sum of tokens * min(1, c * weight / tokens) is ``keep`` of all tokens, as far as weights reach.

    From below: cells that are kept whole at c are set apart, and c is raised so that the others make up for the rest, until
    no more cells are kept whole. Each turn is one sum over the cells.
    """
    need = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    some, c = cells.where("tokens > 0 AND weight > 0").withColumn("rate", F.col("weight") / F.col("tokens")), 0.0
    while True:
        whole = F.col("rate") * c >= 1
        row = some.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0))).first()
        more = (need - row[0]) / row[1] if row[1] > 0 else c
        if more <= c * (1 + 1e-12):
            return c
        c = more


def draw(row_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1, the same for the same id."""
    return F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed)), 11) / F.lit(float(2**53))


def _mixed(docs: DataFrame, id_col: str, text_col: str, targets: dict[str, dict] | None, keep: float, rounds: int) -> DataFrame:
    """(own, row_id, source, lang, topic, n_tokens, rate, probability, sampled) of each row of ``docs``."""
    scratch = frames.Scratch(docs.sparkSession, "mixing")
    rows = measured(docs, scratch, id_col, text_col)
    cells = scratch.write(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, scratch, targets, rounds)
    c = scale(raked, keep)
    rates = raked.select(F.col("source").alias("s_"), F.col("lang").alias("l_"), F.col("topic").alias("t_"), F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("rate"))
    found = rows.join(rates, rows["source"].eqNullSafe(rates["s_"]) & rows["lang"].eqNullSafe(rates["l_"]) & rows["topic"].eqNullSafe(rates["t_"])).drop("s_", "l_", "t_")
    p = F.when(F.col("rate").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("rate") * c))
    return found.withColumn("probability", p).withColumn("sampled", draw(F.col("row_id")) < F.col("probability"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """(row_id, source, lang, topic, n_tokens, rate, probability, sampled) of each row of ``docs``."""
    return _mixed(docs.select(*[c for c in dict.fromkeys([id_col, text_col, "source", "lang", "topic"]) if c in docs.columns]), id_col, text_col, targets, keep, rounds).drop("own")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that were drawn, with their columns."""
    return _mixed(docs, id_col, text_col, targets, keep, ROUNDS).where("sampled").select("own.*")
