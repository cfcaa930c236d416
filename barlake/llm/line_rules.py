"""Line-first cleaning: judge each line, remove the lines that fail, reject documents that lose too much text.

A line fails as
- *navigation*: separators (``|``, ``>``, bullets and the like, standing alone) cut it into three parts or more, of at most three words
  each on average, whatever the words are;
- *punctuation*: over a third of its words carry one of the symbols ``#*$%&|<>`` or ``!!``;
- *boilerplate*: half of its words or more are addresses of the web or of mail, or it is a short line with a copyright sign and a year,
  or a short one with one of the fixed notices, in English, German, French or Spanish.
A line that repeats an earlier one is removed as well. The document is kept if at least ``MIN_LEFT`` of its word
characters are left and the base limits (at least ten words, no more than a fifth of them in repeated five-word
windows) hold.

Null or empty text: no words, so it is rejected. Nulls in other columns, repeated rows and ties change nothing: every
row is judged by itself. An empty table gives an empty table. Columns of the input are kept; those that clash with an
output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import frames, words

MIN_WORDS, MAX_REPEAT, MIN_LEFT, WINDOW = 10, 0.20, 0.5, 5
_SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ODD_WORD = re.compile(r"[#*$%&|<>]|!!")
#: What stands alone between the parts of a menu; notices.
_BETWEEN = frozenset(["|", ">", ">>", "»", "›", "•", "·", "/", "::", "→", "–", "—"])
_NOTICES = [
    "cookie policy", "cookie settings", "all rights reserved", "terms of use", "terms of service", "privacy policy", "enable javascript", "click here to", "subscribe to our", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-einstellungen", "allgemeine geschäftsbedingungen", "javascript aktivieren",
    "tous droits réservés", "politique de confidentialité", "politique relative aux cookies", "conditions d'utilisation", "mentions légales", "activer javascript",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "condiciones de uso", "aviso legal", "habilitar javascript",
]
_NOTICE = re.compile("|".join(map(re.escape, _NOTICES)))
_OWNED = re.compile(r"(?:©|\(c\)|copyright)\s.{0,40}\b(?:19|20)[0-9]{2}\b")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")

STATS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_bad_lines", "long"), ("left_share", "double"), ("cleaned", "string")]


def repeated_words(found: list[bytes]) -> int:
    """Words that stand in a five-word window found at least twice in the text."""
    runs = words.windows(words.word_hashes(found), WINDOW)
    if len(runs) < 2:
        return 0
    _, at, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[at] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def navigation(tokens: list[str]) -> bool:
    cuts = sum(t in _BETWEEN for t in tokens)
    return cuts >= 2 and len(tokens) - cuts <= 3 * (cuts + 1)


def boilerplate(line: str, tokens: list[str]) -> bool:
    if ("/" in line or "@" in line or "www." in line) and 2 * sum(1 for t in tokens if _ADDRESS.fullmatch(t)) >= len(tokens):
        return True
    low = line.lower()
    return len(tokens) <= 30 and bool(_NOTICE.search(low) or _OWNED.search(low))


def bad_line(line: str) -> bool:
    """Whether a line with words fails the punctuation, navigation or boilerplate rule."""
    tokens = line.split()
    odd = sum(1 for w in tokens if _ODD_WORD.search(w)) if _ODD_WORD.search(line) else 0
    return odd * 3 > len(tokens) or navigation(tokens) or boilerplate(line, tokens)


def judge(text: str | None) -> tuple:
    """The values of ``STATS`` for one text."""
    text = text or ""
    found = words.split(text)
    n, chars = len(found), len(text.translate(_SPACE))
    seen: set[str] = set()
    good: list[str] = []
    dup = bad = left = 0
    for line in text.split("\n"):
        bare = line.translate(_SPACE)
        if not bare:
            good.append(line)
        elif line in seen:
            dup += 1
        else:
            seen.add(line)
            if bad_line(line):
                bad += 1
            else:
                left += len(bare)
                good.append(line)
    repeat = repeated_words(found)
    failed = n < MIN_WORDS or 100 * repeat > 100 * MAX_REPEAT * n
    share = left / chars if chars else 0.0
    return n, chars, len(_SYMBOLS.findall(text)), dup, repeat, failed, not failed and share >= MIN_LEFT, bad, share, "\n".join(good)


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATS``; ``cleaned`` is the text without its failed and repeated lines."""
    frames.small_batches(docs.sparkSession)
    names = [k for k, _ in STATS]
    source = docs.select(*[docs[c] for c in docs.columns if c == text_col or c not in names])
    schema = T.StructType([f for f in source.schema.fields if f.name not in names]).fieldNames()
    full = T.StructType([*(f for f in source.schema.fields if f.name in schema)])
    for k, t in STATS:
        full = full.add(k, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.string()]
        for b in batches:
            rows = [judge(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            own = [b.column(i) for i, c in enumerate(b.schema.names) if c in schema]
            made = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *made], [*[c for c in b.schema.names if c in schema], *names])

    return source.mapInArrow(run, full)
