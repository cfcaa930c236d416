"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

A document's set: hashes (64 bits) of its distinct five-word shingles. Two collections of ``BANDS`` short bands, each a
hash of ``ROWS`` minima, make ``BANDS * BANDS`` table keys, one for every pair of a band from either collection: 2 * 24 * 4
minima serve 576 tables of 8 minima each, of which a pair with similarity 0.75 meets in 57 on average and misses all
with probability 0.0002.

Steps, all Spark joins and groups:
1. One pass over the texts makes set size, set fingerprint (128 bits) and bands. Equal sets become one node, the least
   number among them (partial aggregation, so a group of copies of any size is one row per task).
2. A band that only one node has can be in no shared key: such bands go first, then keys are formed from what is left,
   and only keys of two nodes or more are kept.
3. Candidates are the pairs of a node with the least node of a bucket, as far as the set sizes allow a link. First every
   node is verified against one of them, the one it shares most tables with: one pair a node, whatever the size of a
   group. Links are joined to components; then the candidates of different components that are left are verified.
4. Nodes of buckets whose other members still are of several components are open. All pairs of open nodes of different
   components that are similar enough are found in an exact way: shingles are put in one order (first those that only one
   component has, then rare before common), and two sets so similar share one of their first shingles, at places that
   leave enough to come (prefix, length and position filters). What shares one is verified like the candidates before.
   So every pair that meets in a table is decided, and no pairs within a bucket are made.

A node's number is its document's id; rows of an id that repeats are numbered by a hash of id and text instead, and are
joined to one component at the end.

Results for odd input: null or empty text has no set (n_shingles 0), is linked with nothing and kept. A row without an id
is linked with nothing: component null, kept. Rows that repeat an id count as one document, whose links are those of all
its texts. Ties cannot matter: the least id names a group. Empty table: empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames, words
from .components import components

SIZE, BANDS, ROWS, SEED = 5, 24, 4, 11
PERCENT = 75
#: Bits of the filter of ``texts_of``: at most 131,072 rows of two longs.
FILTER_BITS = 1 << 23
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, size=2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    out = np.empty(len(_FACTORS), np.uint64)
    part = max(1, min(16, 1_000_000 // max(1, len(hashes))))
    for i in range(0, len(out), part):
        out[i : i + part] = np.multiply.outer(_FACTORS[i : i + part], hashes).min(axis=1)
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """The short bands of both collections, which the lowest bit tells apart."""
    rows = minima(hashes).reshape(2 * BANDS, ROWS)
    out = np.arange(2 * BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    collection = np.repeat(np.arange(2, dtype=np.uint64), BANDS)
    for r in range(ROWS):
        out = (out ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return (out & ~np.uint64(1) | collection).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, prints, made, ends = [], [], [], [0]
        for text in b.column(2).to_pylist():
            s = words.shingles(text, SIZE)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                made.append(bands(s))
            ends.append(ends[-1] + (2 * BANDS if len(s) else 0))
        flat = np.concatenate(made) if made else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "number", "n_shingles", "print", "bands"])


def numbered(docs: DataFrame, scratch: frames.Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (doc_id, text) with a ``number`` that names one text, and the ids that repeat (None if none does).

    Hashed numbers start at 2 ** 62, so that below it ids that repeat never change what others are called.
    """
    again = scratch.write(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return docs.select("doc_id", F.col("doc_id").alias("number"), "text"), None
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(2**62)
    joined = docs.join(again, F.col("doc_id") == F.col("again"), "left")
    return joined.select("doc_id", F.when(F.col("again").isNull(), F.col("doc_id")).otherwise(hashed).alias("number"), "text"), again


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, number, n_shingles, print, bands) of each of ``rows`` (doc_id, number, text)."""
    frames.small_batches(rows.sparkSession)
    return rows.mapInArrow(_sign, "doc_id long, number long, n_shingles long, print binary, bands array<long>")


def live_bands(nodes: DataFrame) -> DataFrame:
    """(node, size, first, second): the bands of either collection that some other node has too; nodes without both are left out.

    A band's lowest bit tells its collection.
    """
    single = nodes.select("node", F.explode("bands").alias("band"))
    shared = single.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    live = single.join(shared, "band", "left_semi")
    first, second = (F.collect_list(F.when(is_own, F.col("band"))) for is_own in (F.col("band") % 2 == 0, F.col("band") % 2 != 0))
    lists = live.groupBy("node").agg(first.alias("first"), second.alias("second")).where((F.size("first") > 0) & (F.size("second") > 0))
    return lists.join(nodes.select("node", "size"), "node")


def table_keys(live: DataFrame) -> DataFrame:
    """(node, size, key, lo, lo_size) for every pair of a first and a second band of a node, as far as another node has the
    key; ``lo`` is the least node that has it."""
    single = live.select("node", "size", "second", F.explode("first").alias("one")).select("node", "size", "one", F.explode("second").alias("two")).select("node", "size", F.xxhash64("one", "two").alias("key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.min_by("size", "node").alias("lo_size")).where("n > 1").drop("n")
    return single.join(shared, "key")


def met(keys: DataFrame) -> DataFrame:
    """(a, b, n, fits): nodes b that meet a, the least of a bucket, in n tables; whether their sizes allow a link."""
    fits = F.expr(f"100 * least(size, lo_size) >= {PERCENT} * greatest(size, lo_size)")
    return keys.where("node <> lo").groupBy(F.col("lo").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"), F.max(fits).alias("fits"))


def closest(found: DataFrame) -> DataFrame:
    """(a, b): for each b the a that fits and with which it shares most tables, the least at a tie."""
    return found.where("fits").groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def apart(found: DataFrame, tried: DataFrame, groups: DataFrame) -> DataFrame:
    """The (a, b) of ``found`` that fit, are of different components and were not tried."""
    of = {k: groups.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab"}
    both = found.where("fits").select("a", "b").join(tried, ["a", "b"], "left_anti").join(of["b"], "b", "left").join(of["a"], "a", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def open_nodes(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, c): the nodes that may meet a node of another component c in a bucket of which neither is the least.

    Buckets with the same least node are taken together, which opens a few nodes more and needs a row for each pair of a
    node and a least one, not for each of its keys.
    """
    rest = found.select("a", F.col("b").alias("node")).join(groups, "node", "left").select("a", "node", F.coalesce("component", "node").alias("c"))
    mixed = rest.groupBy("a").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi")).where("c_lo < c_hi").select("a")
    return rest.join(mixed, "a", "left_semi").select("node", "c").distinct()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [words.shingles(t, SIZE).view(np.int64) for t in b.column(2).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "c", "size", "set"])


def similar_candidates(opened: DataFrame, texts: DataFrame, scratch: frames.Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of ``opened`` (node, c) with different c: all that are similar enough, and few others.

    ``PERCENT`` of the union is o shingles in common with 7 * o >= 3 * (sizes added up), as 75 / 175 is 3 / 7. The first
    common shingle, at places p and q of sets of sizes m and n, leaves at most 1 + min(m - p, n - q) in common. A common
    shingle belongs to two components, so that all others, which come first in the order, need no row but a count.
    """
    own = opened.join(texts.withColumnRenamed("number", "node"), "node").select("node", "c", "text")
    sets = scratch.write(own.mapInArrow(_shingled, "node long, c long, size long, set array<long>"))
    single = sets.select("node", "c", "size", F.explode("set").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle", "n")
    of_set = Window.partitionBy("node")
    placed = single.join(common, "shingle").withColumn("left", F.count("*").over(of_set)).withColumn("rank", F.row_number().over(of_set.orderBy("n", "shingle")))
    placed = placed.withColumn("place", F.col("size") - F.col("left") + F.col("rank"))
    # the larger set of a pair has 3/4 of its shingles in common, the smaller 6/7
    first = scratch.write(placed.where("4 * (1 + size - place) >= 3 * size").select("shingle", "node", "c", "size", "place"))
    large, small = (first.select("shingle", *[F.col(x).alias(f"{x}_{k}") for x in ("node", "c", "size", "place")]) for k in "ms")
    small = small.where("7 * (1 + size_s - place_s) >= 6 * size_s")
    fits = "c_m <> c_s AND (size_s, node_s) < (size_m, node_m) AND 4 * size_s >= 3 * size_m AND 7 * (1 + least(size_m - place_m, size_s - place_s)) >= 3 * (size_m + size_s)"
    return large.join(small, "shingle").where(fits).select(F.least("node_m", "node_s").alias("a"), F.greatest("node_m", "node_s").alias("b")).distinct()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}
    for b in batches:
        a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(a, c, strict=True)):
            if len(known) > 512:
                known.clear()
            for node, col in ((x, 2), (y, 3)):
                if node not in known:
                    known[node] = words.shingles(b.column(col)[i].as_py(), SIZE)
            s, t = known[x], known[y]
            both = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) * 100 >= PERCENT * max(len(s), len(t)) else 0
            if both and 100 * both >= PERCENT * (len(s) + len(t) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), b.column(1).take(pa.array(keep, pa.int32()))], ["a", "b"])


def texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (number, text) whose number is a ``node``.

    A bit for each of ``FILTER_BITS`` hashes of a node (a table of bounded size, which may be broadcast) keeps most other
    texts out of the join's shuffle, as long as the nodes are fewer than the bits.
    """

    def place(x: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))
        return F.shiftright(at, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({x}), {FILTER_BITS}) % 64 as int))")

    word, bit = place("node")
    bits = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    word, bit = place("number")
    some = texts.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    return some.select("number", "text").join(nodes.select(F.col("node").alias("number")), "number", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough; ``texts``: (number, text), one of each number."""
    a, b = (texts.select(F.col("number").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    scratch = frames.Scratch(docs.sparkSession, "minhash")
    rows, again = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scratch)
    texts = rows.select("number", "text")
    if again is not None:
        some = texts.where(f"number >= {2**62}")
        texts = texts.where(f"number < {2**62}").union(some.groupBy("number").agg(F.max("text").alias("text")))
    signed = scratch.write(signatures(rows))
    nodes = scratch.write(signed.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("number").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))
    live = scratch.write(live_bands(nodes))
    found = scratch.write(met(table_keys(live)))
    held = scratch.write(texts_of(live, texts))  # no other texts are compared
    scratch.free(live)

    first = scratch.write(closest(found))
    links = scratch.write(verify(first, held))
    groups = scratch.write(components(links, scratch))
    second = scratch.write(apart(found, first, groups))
    more = scratch.write(verify(second, held))
    known = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
    groups = scratch.write(components(known.union(more), scratch))

    opened = scratch.write(open_nodes(found, groups))
    last = scratch.write(similar_candidates(opened, held, scratch).join(found.where("fits").select("a", "b"), ["a", "b"], "left_anti"))
    known = groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(verify(last, held))
    of_row = nodes.select("print", "node")
    if again is not None:
        own = signed.join(again, F.col("doc_id") == F.col("again"), "left_semi").join(of_row, "print").select("doc_id", "node").distinct()
        known = known.union(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    groups = scratch.write(components(known, scratch))
    scratch.free(held, found, first, links, second, more, opened, last)

    named = of_row.join(groups, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    if again is not None:  # hashed numbers become ids
        out = out.join(out.where("doc_id IS NOT NULL AND component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "component", "left").withColumn("component", F.col("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id. Rows without an id or a set stay."""
    gone = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("minhash_gone_")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("minhash_gone_"), "left_anti")
