"""Toxicity: hashed word n-grams and skip-grams, weights by FTRL-proximal logistic regression.

Features of a text: its distinct lower-cased words (letters and digits, other characters cut off), pairs of neighbours, and
pairs with one word between, hashed into ``DIMS``. Training takes at most ``PER_CLASS`` labelled documents of each
class, none of them held out, and weights them back to the classes' shares among all labels; their features are made on the executors. Of the fitted weights only
those that are not zero are sent to the tasks that score every document, as numbers and values; the L1 term leaves few.

Null or empty text: the score of the bias alone. No labels at all, or of one class only: the score is that of the label
share. Null ids, repeated rows: scored each. Empty table: empty result. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, ftrl, labels, words

#: Feature numbers; most training documents of label 0 and of label 1.
DIMS, PER_CLASS, SEED = 1 << 20, (7500, 2500), 3
#: Bytes of training features that the driver holds at a time.
PIECE = 32 << 20
ALPHA, L1, L2, PASSES = 2.0, 4.0, 0.01, 4
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    found = [w.encode() for w in _WORD.findall((text or "").lower())]
    if not found:
        return np.empty(0, np.int64)
    h = words.word_hashes(found)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1)
    every = np.concatenate([h, two, skip]) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique((every >> np.uint64(44)).astype(np.int64))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [features(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.binary())], ["doc_id", "label", "found"])


def _views(found: pa.BinaryArray) -> list[np.ndarray]:
    """The feature numbers of each row, as they stand in the Arrow buffer."""
    ends, flat = np.frombuffer(found.buffers()[1], "<i4")[found.offset : found.offset + len(found) + 1] // 4, np.frombuffer(found.buffers()[2] or b"", "<i4")
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def cut(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges (first id, last id) of ``sizes`` (id, bytes), sorted by id: each of at most ``most`` bytes, or of one row."""
    out, held = [], most + 1
    for ident, size in sizes:
        if held + size > most:
            out.append((ident, ident))
            held = 0
        out[-1] = (out[-1][0], ident)
        held += size
    return out


def train(docs: DataFrame, marks: DataFrame, column: str = "toxic", per_class: tuple[int, int] = PER_CLASS, piece: int = PIECE) -> np.ndarray:
    """Weights from at most ``per_class`` documents of label 0 and of label 1; ``docs``: (doc_id, text).

    Their features are written to the shared folder and come to the driver by ranges of ids of ``piece`` bytes, in every
    pass again if there are several; one document has at most ``DIMS`` features, 4 bytes each, and they stay as they came.
    """
    spark = docs.sparkSession
    frames.small_batches(spark)
    sample = labels.training_sample(marks, column, per_class, SEED)
    scratch = frames.Scratch(spark, "toxicity")
    table = scratch.write(labels.one_each(docs.join(F.broadcast(sample), "doc_id")).mapInArrow(_extract, "doc_id long, label int, found binary"))
    known = sorted(table.select("doc_id", "label", F.octet_length("found").alias("size")).collect())
    y = np.array([r.label for r in known], float)
    if not len(known) or y.min() == y.max():
        w = np.zeros(DIMS + 1, np.float32)
        share = (y.sum() + 1) / (len(y) + 2)
        w[DIMS] = np.log(share / (1 - share))
        scratch.free(table)
        return w
    # each class counts as it does among all labels, whatever the bounds took of it; 1 on average, so that L1 keeps its measure
    counts = np.array(labels.sampling(marks, column, per_class))
    counts /= counts[y.astype(int)].mean()
    ranges = cut([(r.doc_id, r.size) for r in known], piece)
    if len(ranges) > 1:  # so that a range is read from few files
        whole, table = table, scratch.write(table.repartitionByRange(len(ranges), "doc_id").sortWithinPartitions("doc_id"))
        scratch.free(whole)

    def read(first: int, last: int) -> ftrl.Piece:
        rows = table.where(F.col("doc_id").between(first, last)).toArrow()
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        found = [x for part in rows["found"].chunks for x in _views(part)]
        label = rows["label"].to_numpy()[order]
        return [found[i] for i in order], label, counts[label]

    pieces = [lambda x=x: read(*x) for x in ranges]
    if len(pieces) == 1:
        only = read(*ranges[0])
        pieces = [lambda: only]
    w = ftrl.fit_pieces(pieces, DIMS, alpha=ALPHA, l1=L1, l2=L2, passes=PASSES)
    scratch.free(table)
    return w


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature numbers, their weights, bias) of the weights that are not zero."""
    at = np.flatnonzero(weights[:-1])
    return at.astype(np.int32), weights[at], float(weights[-1])


def totals(found: list[np.ndarray], at: np.ndarray, values: np.ndarray, bias: float) -> np.ndarray:
    """The sum of the weights of each text's features, and the bias."""
    if not len(at):
        return np.full(len(found), bias)
    every = np.concatenate([*found, np.empty(0, np.int64)])
    near = np.minimum(np.searchsorted(at, every), len(at) - 1)
    each = np.where(at[near] == every, values[near], 0.0)
    return np.bincount(np.repeat(np.arange(len(found)), [len(x) for x in found]), each, minlength=len(found)) + bias


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(sparse(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = totals([features(t) for t in b.column(1).to_pylist()], *sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; ``marks``: (doc_id, toxic)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(own, train(own, marks))
    return scored.select("doc_id", labels.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
