"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``STATISTICS`` of whole texts (counts and shares, no labels, language, source or id).
2. Small trees on bootstrap draws of the training rows; every path from a root to a node is a conjunctive rule.
3. Lasso logistic regression over the rules (proximal gradient, accelerated); most weights are zero.
4. The rules that are left become one Spark column expression over the statistics.

Training takes at most ``PER_CLASS`` labelled documents of each class, none of them held out; only their statistics come
to the driver (bounded by that parameter). Classes are weighted as they are among all labelled training rows.

Null or empty text: all statistics 0, scored like any other. No labels, or one class only: the score is the label share.
Null ids, repeated rows: scored each. Empty table: empty result. Columns of the input that clash are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, labels
from .line_rules import repeated_words

PER_CLASS, SEED, TREES, DEPTH, LASSO = 6000, 23, 24, 3, 0.003
STATISTICS = ["q_words", "q_word_len", "q_symbols", "q_upper", "q_digits", "q_stops", "q_repeat", "q_distinct", "q_line_words", "q_line_ends", "q_dup_lines", "q_bars", "q_shouts", "q_marked"]
_SYMBOLS = re.compile(rb"[#*$%&|<>~^=_]")
_MARKED = re.compile(rb"[#*$%&]{2,}")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "replace")
    found = data.split()
    n = len(found)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, found))
    share = lambda k, of: k / max(1, of)
    return [
        float(n), chars / n, share(len(_SYMBOLS.findall(data)), n), share(chars - len(b"".join(found).translate(None, _UPPER)), chars),
        share(chars - len(b"".join(found).translate(None, _DIGITS)), chars), share(data.count(b".") + data.count(b",") + data.count(b"?"), n), repeated_words(found) / n,
        len(set(found)) / n, n / len(lines), share(sum(x.rstrip().endswith((b".", b"?", b"!", b":", b'"')) for x in lines), len(lines)),
        1 - len(set(lines)) / len(lines), share(found.count(b"|"), n), share(data.count(b"!!"), n), share(len(_MARKED.findall(data)), n),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made.T.copy())], ["doc_id", *STATISTICS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) of each row."""
    frames.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, bound), all of which must hold


def _split(x: np.ndarray, y: np.ndarray, some: np.ndarray) -> tuple[int, float] | None:
    """The statistic and bound that lower the squared error most, among quantiles."""
    best, found = 1e-9, None
    base = y.sum() ** 2 / len(y)
    for f in some:
        for bound in np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24))):
            above = x[:, f] > bound
            k = int(above.sum())
            if 10 <= k <= len(y) - 10:
                s = y[above].sum()
                gain = s * s / k + (y.sum() - s) ** 2 / (len(y) - k) - base
                if gain > best * 1.000001:
                    best, found = gain, (int(f), float(bound))
    return found


def _paths(x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator, path: Rule = ()) -> list[Rule]:
    out = [path] if path else []
    cut = _split(x, y, draw.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]) if depth and len(y) >= 20 and y.min() < y.max() else None
    if cut:
        f, bound = cut
        above = x[:, f] > bound
        for side in (True, False):
            out += _paths(x[above == side], y[above == side], depth - 1, draw, (*path, (f, side, bound)))
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(lambda a, b: a & b, [(x[:, f] > bound) == above for f, above, bound in rule])


def lasso_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the weighted log loss plus ``penalty`` times the L1 norm."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    rate = 4 / np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2
    w = v = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -35, 35)))
        u = v - rate * (x1.T @ (weight * (p - y)))
        new = np.append(np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - rate * penalty, 0), u[-1])
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, intercept)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    draw = np.random.default_rng(SEED)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        pick = draw.choice(len(y), min(len(y), 3000), p=weight / weight.sum())
        rules |= dict.fromkeys(_paths(x[pick], y[pick], DEPTH, draw))
    each = list(rules)
    if not each:
        share = float((weight * y).sum() / weight.sum())
        return [], float(np.log(share / (1 - share)))
    w, intercept = lasso_logistic(np.stack([holds(r, x) for r in each], 1).astype(float), y, weight, LASSO)
    return [(r, float(k)) for r, k in zip(each, w, strict=True) if k], intercept


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as one column expression over the statistics."""
    total = F.lit(intercept)
    for rule, k in rules:
        condition = reduce(lambda a, b: a & b, [F.col(STATISTICS[f]) > bound if above else F.col(STATISTICS[f]) <= bound for f, above, bound in rule])
        total = total + F.when(condition, k).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, marks: DataFrame, column: str = "quality", per_class: int = PER_CLASS) -> tuple[list[tuple[Rule, float]], float]:
    """Rules from at most ``per_class`` documents of each class; ``docs``: (doc_id, text)."""
    sample = labels.training_sample(marks, column, (per_class, per_class), SEED)
    known = measured(labels.one_each(docs.join(F.broadcast(sample), "doc_id"))).collect()
    shares = {r.label: r["count"] for r in labels.known_labels(marks, column).groupBy("label").count().where("label IN (0, 1)").collect()}
    marked = {r.doc_id: r.label for r in sample.collect()}
    known.sort()
    x = np.array([r[1:] for r in known], float).reshape(-1, len(STATISTICS))
    y = np.array([marked[r.doc_id] for r in known], float)
    weight = np.where(y > 0, shares.get(1, 1) / max(1, (y > 0).sum()), shares.get(0, 1) / max(1, (y == 0).sum()))
    return fit(x, y, weight)


def classify(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; ``marks``: (doc_id, quality)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rules, intercept = train(own, marks)
    scored = measured(own).withColumn("score", compiled(rules, intercept))
    return scored.select("doc_id", labels.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
