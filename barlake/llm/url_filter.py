"""URL filter: rules for hosts and paths, and for the rest trust and distrust propagated over the host graph.

A rule fits its host and all subdomains if the url's path starts with the rule's path; of several the longest (host and
path together) wins. Other pages take their host's verdict. Host edges: absolute links in the page's html, and between a
host and its parent (``www.site.example.com`` and ``site.example.com``; parents of fewer than three labels are shared by
strangers and not used). Trust is the personalised PageRank from hosts with allowed pages; distrust that of the reversed
edges from hosts with blocked pages (who links to bad hosts is bad). A host is blocked if its distrust is over
``RATIO`` times its trust.

Edges, seeds and ranks stay distributed; a step is one join and one partially aggregated sum over all edges of both
directions, and is written to the shared folder. Pages and edges per host are counted before any join. The last join
leaves the choice to the optimizer: host verdicts are broadcast only if measured small, else the hot side can be split.

Null url or none with ``://``: host and path empty, no rule, allow. Null html: no links. Null ids, repeated rows: each
row is judged by itself. Empty table: empty result. Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

#: Fixed values: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Steps end when no rank changes by more than ``TOLERANCE`` of itself.
DAMPING, TOLERANCE, RATIO = 0.85, 1e-4, 4.0
#: Steps between two written tables; the last of them is tested.
AT_ONCE = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts, n counting the links."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]*)"), F.lit(1)))).alias("to"))
    linked = links.select(F.col("host").alias("src"), host_of(F.col("to")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    parent = F.expr("substring(host, instr(host, '.') + 1)")
    family = pages.select("host").distinct().select("host", parent.alias("up")).where("length(up) - length(replace(up, '.', '')) >= 2")
    near = family.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1).cast("long").alias("n"))
    near = near.union(near.select("dst", "src", "n"))
    return linked.union(near).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: frames.Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). ``seeds``: (host, trust, distrust), each summing to 1 or 0.

    Ranks only grow from step to step, by the share that has come one link further; a host reached for the first time
    changes by all of its rank. So the end means that every host with a path from a seed is reached, at any distance.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    moves = scratch.write(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    start = scratch.write(seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, rank)")).where("rank > 0"))
    base = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))

    def step(rank: DataFrame) -> DataFrame:
        flow = moves.join(rank.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        return flow.union(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))

    rank = base
    while True:
        for _ in range(AT_ONCE - 1):
            rank = step(rank)
        now = step(rank).withColumn("before", F.lit(0.0)).union(rank.select("kind", "host", F.lit(0.0), "rank"))
        rank = scratch.write(now.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")))
        if (rank.where("rank > 0").agg(F.max(F.abs(F.col("rank") - F.col("before")) / F.col("rank"))).first()[0] or 0.0) <= tolerance:
            break
    total = F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(total[0].alias("trust"), total[1].alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each page."""
    scratch = frames.Scratch(pages.sparkSession, "urls")
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = base.withColumn("hit", _rule(F.col("host"), F.col("path"), rules))
    counts = scratch.write(ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("a"), F.count_if(F.col("hit.verdict") == "block").alias("b")))
    total = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    seeds = counts.join(F.broadcast(total)).select("host", F.try_divide("a", "all_a").alias("trust"), F.try_divide("b", "all_b").alias("distrust"))
    ranks = scratch.write(propagate(host_edges(base), seeds, scratch).where("distrust > 0 OR trust > 0"))
    found = ruled.drop("html").join(ranks, "host", "left")
    method = F.when(F.col("distrust") > RATIO * F.col("trust"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
