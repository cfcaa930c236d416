"""Harmonic packing of token sequences.

A document is cut into pieces whose lengths are reciprocal parts of the capacity: whole sequences first, then halves,
quarters and so on down to ``capacity / 32``, largest first; what is left (shorter than that) is its tail. A piece of
length l is in class k = floor(capacity / l): k pieces of class k share a bin. Pieces of exactly capacity / k fill their
bin without padding; tails, a few tokens of a document, waste at most 1/33 of theirs. Every worker fills the bins of each
class by itself, holding fewer than k pieces of a class, so memory does not grow and nothing is shuffled. At the end of a
worker's rows the open bins are closed: the m open pieces of a class of powers of two as bins of powers of two of them,
which need no padding, and the tails of all classes, longest first, one after the other in shared bins.

A bin's id is the worker's number times 2**33 plus a count, so equal input partitions give equal bins when a task runs
again. Null or empty text: its one end token. Null ids are kept. Repeated rows are packed each. Empty table: empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .held import held

CAPACITY, LEAST_PART, END = 2048, 32, 1
#: Distinct runs kept in a worker's token table (about 200 MB); beyond it the half not used for longest goes, and all of it
#: when the worker takes up another operator. Only speed depends on it.
CACHE = 1_000_000
#: How the vocabulary cuts lower-cased text: fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for ASCII and Latin letters, whose case and classes Python and the tokenizer see alike; other text is left to it.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_RUN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile(r"[^\x00-\u012f\u0131-\u024f]")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    """Whether the text is cut here as by the tokenizer: Latin letters only, and nothing that may be a special token."""
    return "<|" not in text and (text.isascii() or not _OTHER.search(text))


class Tokens:
    """Ids of texts by the tokenizer in a file. It looks at each run of characters by itself (a word, a digit, symbols), so
    that runs seen before are looked up: ``index`` has a run's number, ``starts`` and ``lengths`` where its ids stand in
    ``flat``. Tokenizers that split texts otherwise see whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_run = json.dumps(SPLIT)[1:-1] in json.dumps(told["pre_tokenizer"]) and told["model"].get("end_of_word_suffix") == "</w>"
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.now = np.zeros(0, "<u4"), 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        """Number the new ``runs``. Plain ones are encoded many at a time: the last token of each closes a word."""
        plain, other = [r for r in runs if _plain(r)], [r for r in runs if not _plain(r)]
        ids = np.array([i for e in self._encoded([" ".join(plain[k : k + 200]) for k in range(0, len(plain), 200)]) for i in e], "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(plain):  # a run of several words: one by one
            made = self._encoded(plain)
            ids, ends = np.array([i for e in made for i in e], "<u4"), np.cumsum([len(e) for e in made])
        more = self._encoded(other)
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) for e in more], np.int64)]).astype(np.int64)
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, ids, np.array([i for e in more for i in e], "<u4")])
        self.index.update(zip(plain + other, range(len(self.starts), len(self.starts) + len(lengths)), strict=True))
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.full(len(lengths), self.now)])

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        n = self.lengths[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[numbers] - ends + n, n) + np.arange(ends[-1])] if len(n) else self.flat[:0]

    def _forget(self) -> None:
        """Keep the half of the runs that was used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
        names = list(self.index)  # in the order of their numbers
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat, self.lengths, self.used = self._ids(keep), self.lengths[keep], self.used[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, then ``END``."""
        if not self.by_run:
            return [np.array([*e, END], "<u4") for e in self._encoded(texts)]
        self.now += 1
        if len(self.index) > CACHE:
            self._forget()
        # white space is dropped and never joined across, so that parts between it can be told apart
        cut_ = [_RUN.findall(t.lower()) if _plain(t) else [r for p in t.encode().split() for q in [p.decode()] for r in (_RUN.findall(q.lower()) if _plain(q) else [q])] for t in texts]
        get = self.index.get
        numbers = [list(map(get, c)) for c in cut_]
        new = dict.fromkeys(r for c, n in zip(cut_, numbers, strict=True) if None in n for r, i in zip(c, n, strict=True) if i is None)
        if new:
            self._learn(list(new))
            get = self.index.__getitem__
            numbers = [list(map(get, c)) if None in n else n for c, n in zip(cut_, numbers, strict=True)]
        arrays = [np.array(n, np.int64) for n in numbers]
        for a in arrays:
            self.used[a] = self.now
        return [np.append(self._ids(a), np.uint32(END)).astype("<u4") for a in arrays]


def token_ids(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text by the tokenizer in ``path``, without special tokens, then ``END``."""
    return held(f"tokens of {path}", lambda: Tokens(path)).of([t or "" for t in texts])


def cut(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens."""
    out = [capacity] * (total // capacity)
    left, part = total % capacity, capacity // 2
    while part * LEAST_PART >= capacity and part:
        if left >= part:
            out.append(part)
            left -= part
        part //= 2
    return out + [left] * (left > 0)


class Worker:
    """The open bins of one worker. A piece is (doc index, start, length, crc, doc tokens)."""

    def __init__(self, number: int, capacity: int):
        self.next, self.capacity = number << 33, capacity
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        total = sum(p[2] for p in pieces)
        padded = total if total & (total - 1) == 0 else self.capacity
        offset = 0
        for p in pieces:
            yield (*p, self.next, offset, padded)
            offset += p[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            yield from self.close(bin_)

    def finish(self) -> Iterator[tuple]:
        tails: list[tuple] = []
        for _, bin_ in sorted(self.open.items()):
            while bin_ and all(p[2] == bin_[0][2] and p[2] & (p[2] - 1) == 0 for p in bin_):
                m = 1 << (len(bin_).bit_length() - 1)
                yield from self.close(bin_[:m])
                bin_ = bin_[m:]
            tails += bin_
        tails.sort(key=lambda p: -p[2])
        now, filled = [], 0
        for p in tails:
            if filled + p[2] > self.capacity:
                yield from self.close(now)
                now, filled = [], 0
            now.append(p)
            filled += p[2]
        if now:
            yield from self.close(now)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it comes from, its checksum, and its place in a sequence. ``capacity``: a power of two."""
    frames.small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker(TaskContext.get().partitionId(), capacity)
        types = [pa.int64()] * 8

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), token_ids(path, b.column(1).to_pylist()), strict=True):
                at = 0
                for n in cut(len(ids), capacity):
                    out += worker.add((doc, at, n, zlib.crc32(ids[at : at + n]), len(ids)))
                    at += n
            yield batch([(p[0], p[1], p[2], p[3], p[4], *p[5:]) for p in out])
        yield batch(list(worker.finish()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
