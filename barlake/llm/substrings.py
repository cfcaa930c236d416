"""Exact substring dedup by relative Lempel-Ziv parsing against the documents with smaller ids.

Documents are cut into phrases, the blocks of the reference: consecutive windows of ``SIZE`` words with the same seed, the
least hash of their runs of ``SEED`` words. Where a phrase ends depends on its words alone, so a passage is cut
alike in every document, but for its ends. The index of the reference is a table of seeds and of phrases, dealt over the
cluster by hash; every document is factored against all of it by joins:

1. Seeds that only one row has are in no factor. They go first, by a count and a semi-join.
2. A phrase that a document with a smaller id has too is a factor as it stands; neighbouring ones are one long factor.
3. At the ends of a factor the phrases differ. So of seeds with several phrases each phrase is looked at window by window,
   once, in the first document that has it: what a smaller document has of it lengthens the factor.
4. The words of the factors of a document are removed from it.

Two windows count as equal if 64-bit hashes of the windows and of their seeds both are. No key is gathered in one task:
seeds, phrases and windows are counted by partial aggregation, and joins on them can be split. Lists are of one document.

Defined results: null or empty text has no words; texts of fewer than ``SIZE`` words keep all. A null id is neither smaller
nor larger than any: such rows keep all and are no reference. Rows that repeat an id are judged each; none is smaller than
the other. Repeats within one document alone are kept. An empty table gives an empty table; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch_words, frames, minhash, words

SIZE, SEED = 13, 4
#: A place is a window's first word times this, plus the number of windows from there.
PLACE = 16


def seeds(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, at, text) of each window of ``SIZE`` words within one text: the least hash of its runs of ``SEED`` words, its first
    word among all ``hashes``, and its text. ``ends``: the number of words before each text and in all."""
    least, width, wanted = words.windows(hashes, SEED), 1, SIZE - SEED + 1
    n = np.maximum(np.diff(ends) - SIZE + 1, 0)
    at = np.repeat(ends[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    if not len(at):
        return least[:0], at, at
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - wanted + width], least[wanted - width :])
    return least[at], at, np.repeat(np.arange(len(n)), n)


def changes(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a run of equal seeds of one text starts."""
    return np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])])[: len(seed)])


def phrases(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, phrase, place, text) of each phrase of the texts with the word ``hashes``; none with fewer than ``SIZE`` words.

    A phrase has at most ``SIZE - SEED + 1`` windows, so that its first and its last window hold all its words; longer runs
    of windows with one seed, as of words that repeat, are cut from their start.
    """
    (seed, at, text), most = seeds(hashes, ends), SIZE - SEED + 1
    start = changes(seed, text)
    n = np.diff(start, append=len(seed))
    if len(n) and n.max() > most:
        parts = -(-n // most)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + within * most
        n = np.diff(start, append=len(seed))
    first, of = at[start], text[start]
    opened, closed = (words.windows_at(hashes, SIZE, x) for x in (first, first + n - 1))
    phrase = (opened * np.uint64(0x9E3779B97F4A7C15)) ^ (closed + n.astype(np.uint64))
    return seed[start].view(np.int64), phrase.view(np.int64), (first - ends[of]) * PLACE + n, of


def _batch(parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in parts.values()], list(parts))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of each text."""
    for b in batches:
        seed, _, text = seeds(*batch_words.hashes(b.column(0)))
        some = changes(seed, text)
        seed, text = seed[some].view(np.int64), text[some]
        ends = np.searchsorted(text, np.arange(b.num_rows + 1)).tolist()
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            seed[lo:hi].sort()
        yield _batch({"seed": seed[changes(seed, text)]})


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seed, phrase, place, text = phrases(*batch_words.hashes(b.column(2)))
        number, doc = (b.column(k).to_numpy()[text] for k in range(2))
        yield _batch({"seed": seed, "phrase": phrase, "number": number, "doc_id": doc, "place": place})


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the phrases that start at ``places``, with its phrase's seed."""
    for b in batches:
        hashes, ends = batch_words.hashes(b.column(2))
        asked, each = b.column(3).flatten(), np.diff(b.column(3).offsets.to_numpy())
        places, seed = (asked.field(k).to_numpy() for k in ("place", "seed"))
        n, text = places % PLACE, np.repeat(np.arange(b.num_rows), each)
        at = np.repeat(places // PLACE - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.repeat(text, n)
        number, doc = (b.column(k).to_numpy()[text] for k in range(2))
        window = words.windows_at(hashes, SIZE, at + ends[text]).view(np.int64)
        yield _batch({"seed": np.repeat(seed, n), "phrase": window, "number": number, "doc_id": doc, "place": at * PLACE + 1})


def covered(n: int, places: list[int] | None) -> np.ndarray:
    """Which of ``n`` words the windows at ``places`` cover: the document's factors."""
    at = np.array(places or [], np.int64)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at // PLACE, 1)
    np.add.at(steps, at // PLACE + at % PLACE + SIZE - 1, -1)
    return np.cumsum(steps[:n]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            each = words.split(text)
            gone = covered(len(each), places)
            n_words.append(len(each))
            n_removed.append(int(gone.sum()))
            left = b" ".join(compress(each, (~gone).tolist()) if places else each)
            kept.append(left.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def factors(rows: DataFrame, scratch: frames.Scratch) -> DataFrame:
    """(number, places) of the ``rows`` (doc_id, number, text) that have factors: their windows that smaller ids have too."""
    known = rows.where("doc_id IS NOT NULL")
    keys = "seed long, phrase long, number long, doc_id long, place long"
    shared = known.select("text").mapInArrow(_seeds, "seed long").groupBy("seed").count().where("count > 1").select("seed")
    shared = scratch.write(shared)  # joins of two tables as they are dealt can be split where a seed has very many rows
    live = scratch.write(known.select("number", "doc_id", "text").mapInArrow(_parsed, keys).join(shared, "seed", "left_semi"))
    first = scratch.write(live.groupBy("seed", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    whole = live.join(first.where("first < last"), ["seed", "phrase"]).where("doc_id > first").select("number", "place")

    several = scratch.write(first.groupBy("seed").count().where("count > 1").select("seed"))
    ends = live.join(first.join(several, "seed", "left_semi").select("seed", "phrase", F.col("first").alias("doc_id")), ["seed", "phrase", "doc_id"], "left_semi")
    asked = ends.groupBy("number").agg(F.collect_set(F.struct("place", "seed")).alias("places"))
    windows = scratch.write(known.join(asked, "number").select("number", "doc_id", "text", "places").mapInArrow(_windowed, keys))
    again = windows.groupBy("seed", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    longer = windows.join(again, ["seed", "phrase"]).where("doc_id > first").select("number", "place")
    found = scratch.write(whole.union(longer).groupBy("number").agg(F.collect_set("place").alias("places")))
    scratch.free(shared, live, first, several, windows)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs``: the words outside all factors, joined by one space."""
    spark = docs.sparkSession
    scratch = frames.Scratch(spark, "substrings")
    frames.small_batches(spark)
    rows, _ = minhash.numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scratch)
    found = factors(rows, scratch)
    return rows.join(found, "number", "left").select("doc_id", "text", "places").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
