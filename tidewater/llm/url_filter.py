"""URL filter: explicit rules, and for the rest a tree of path templates for each host, judged by the labels that fall under them.

Paths are split at slashes, runs of digits become #, and from the root down each node of a host's tree keeps the segments that are
frequent below it and generalises the others to a wildcard *; levels beyond DEPTH are one wildcard. Sibling branches
whose continuations and labels do not differ by Hoeffding's bound (the test by which automata are merged in grammatical inference) become one, the
largest first, and their counts are pooled. A template's share of blocked labels is smoothed towards that of its parent, the host's
towards that of all hosts; a template is blocked where the share is over one half.

Labels are the verdicts of the rules on the URLs they fit. Trees are tables keyed by host and path prefix, summed before they are
shuffled, so a large host is no single task; only siblings meet in one row, of which a node has at most 1 / SHARE and a wildcard.

Null URLs and those without :// have an empty host and path, which is a host like any other. A literal segment * or # is the same as the wildcard.
Repeated rows, equal and null ids stay rows. URLs may have any length. Without labels all URLs are allowed. An empty table gives no
rows. Other columns are left out.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import maybe_broadcast, saved

#: A segment stays if it has this share of its node's URLs, and no fewer than LEAST of them.
SHARE, LEAST, DEPTH = 0.05, 3, 16
#: Chance of keeping apart branches that are alike; labels that the parent's share weighs as; share from which a template is blocked.
ALPHA, WEIGHT, BLOCKED = 0.05, 4.0, 0.5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def shape(path: Column) -> Column:
    """The path with # for each run of digits, and one wildcard for all segments beyond DEPTH."""
    plain = F.regexp_replace(path, "[0-9]+", "#")
    segments = F.split(plain, "/")
    return F.when(F.size(segments) > DEPTH + 1, F.concat(F.array_join(F.slice(segments, 1, DEPTH), "/"), F.lit("/*"))).otherwise(plain)


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path, ...) with rule and ruling: of the rules that fit, the longest (of equal ones the least). A rule
    fits its host and the hosts below it, where the path starts with its own."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ruling = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    fits = places.select("host", "path", F.explode(suffixes).alias("suffix")).join(maybe_broadcast(ruling), "suffix").filter(F.expr("startswith(path, prefix)"))
    named = F.concat("suffix", "prefix")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.char_length(named)).alias("n"), named.alias("rule"), "verdict")).alias("best"))
    return places.join(saved(best, "ruled"), ["host", "path"], "left").select(*places.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruling"))


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, ...) with template: level by level, what is rare below its node becomes a wildcard."""
    # the part before the first slash is no level: it is empty, or the whole of a path without a slash
    state = shapes.withColumn("segments", F.split("shape", "/")).withColumn("template", F.col("segments")[0])
    done, level = [], 1
    while True:
        done.append(state.filter(F.size("segments") <= level))
        state = state.filter(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
        children = saved(state.groupBy("host", "template", "segment").agg(F.sum("n").alias("n")), "children")
        if children.isEmpty():
            break
        totals = children.groupBy("host", "template").agg(F.sum("n").alias("total"))
        kept = children.join(totals, ["host", "template"]).filter((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("total")))
        known = saved(kept.select("host", "template", "segment", F.lit(True).alias("kept")), "kept")
        here = F.when(F.col("kept"), F.col("segment")).otherwise("*")
        joined = state.join(known, ["host", "template", "segment"], "left")
        state = saved(joined.withColumn("template", F.concat("template", F.lit("/"), here)).drop("segment", "kept"), "templates")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("segments")


def _prefixes(template: Column) -> Column:
    """level, node (path down to it), parent, segment of each node on a template, its root first."""
    segments = F.split(template, "/")
    upto = lambda i: F.array_join(F.slice(segments, 1, i), "/")
    return F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.struct(i.alias("level"), upto(i).alias("node"), F.when(i > 1, upto(i - 1)).alias("parent"), F.get(segments, i - 1).alias("segment")))


def tree(leaves: DataFrame, template: str = "template") -> DataFrame:
    """host, node, parent, segment, n, allowed, blocked, ended (URLs that end there): a row for each node."""
    at = leaves.select("host", F.col(template).alias("leaf"), "n", "allowed", "blocked", F.explode(_prefixes(F.col(template))).alias("p"))
    sums = [F.sum(c).alias(c) for c in ("n", "allowed", "blocked")]
    return at.groupBy("host", F.col("p.node").alias("node"), F.col("p.parent").alias("parent"), F.col("p.segment").alias("segment")).agg(*sums, F.sum(F.when(F.col("p.node") == F.col("leaf"), F.col("n")).otherwise(0)).alias("ended"))


def differ(hits: float, of: float, others: float, of_others: float) -> bool:
    """True if two frequencies differ by more than Hoeffding's bound; never without cases on both sides."""
    if not of or not of_others:
        return False
    return abs(hits / of - others / of_others) >= math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(of) + 1 / math.sqrt(of_others))


def alike(a: dict, b: dict) -> bool:
    if differ(a["blocked"], a["allowed"] + a["blocked"], b["blocked"], b["allowed"] + b["blocked"]) or differ(a["ended"], a["n"], b["ended"], b["n"]):
        return False
    return not any(differ(a["next"].get(s, 0), a["n"], b["next"].get(s, 0), b["n"]) for s in a["next"].keys() | b["next"].keys())


def leaders(siblings: list[dict]) -> dict[str, str]:
    """Segment to the segment of the branch it is merged into (its own if none)."""
    groups: list[dict] = []
    out = {}
    for branch in sorted(siblings, key=lambda x: (-x["n"], x["segment"])):
        for group in groups:
            if alike(group, branch):
                for c in ("n", "allowed", "blocked", "ended"):
                    group[c] += branch[c]
                group["next"] = {s: group["next"].get(s, 0) + branch["next"].get(s, 0) for s in group["next"].keys() | branch["next"].keys()}
                out[branch["segment"]] = group["segment"]
                break
        else:
            groups.append(dict(branch))
            out[branch["segment"]] = branch["segment"]
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("segment", T.StringType()).add("leader", T.StringType())))
def _leaders(siblings: pd.Series) -> pd.Series:
    out = []
    for each in siblings:
        found = leaders([{**x, "next": {c["segment"]: c["n"] for c in x["next"]}} for x in each])
        out.append([{"segment": s, "leader": t} for s, t in found.items() if s != t])
    return pd.Series(out, dtype=object)


def merged(leaves: DataFrame) -> DataFrame:
    """leaves (host, template, n, allowed, blocked, ...) with merged: the template in which each branch has the name of the one that it is merged into."""
    nodes = saved(tree(leaves), "nodes")
    below = nodes.filter(F.col("parent").isNotNull()).groupBy("host", F.col("parent").alias("node")).agg(F.collect_list(F.struct("segment", "n")).alias("next"))
    full = nodes.filter(F.col("parent").isNotNull()).join(below, ["host", "node"], "left").withColumn("next", F.coalesce("next", F.array().cast("array<struct<segment:string,n:bigint>>")))
    siblings = full.groupBy("host", "parent").agg(F.collect_list(F.struct("segment", "n", "allowed", "blocked", "ended", "next")).alias("siblings"))
    renamed = saved(siblings.filter(F.size("siblings") > 1).select("host", "parent", F.inline(_leaders("siblings"))), "renamed")
    at = leaves.select("host", "template").distinct().select("host", "template", F.explode(_prefixes(F.col("template"))).alias("p")).select("host", "template", "p.level", "p.parent", "p.segment")
    named = at.join(renamed, ["host", "parent", "segment"], "left").groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", F.coalesce("leader", "segment").alias("segment")))).alias("path"))
    names = saved(named.select("host", "template", F.array_join(F.transform("path", lambda x: x["segment"]), "/").alias("merged")), "merged")
    return leaves.join(names, ["host", "template"])


def judged(leaves: DataFrame) -> DataFrame:
    """host, merged, blocked_share: the share of blocked labels of each merged template, smoothed down its branch."""
    nodes = tree(leaves, "merged").select("host", "node", "allowed", "blocked")
    total = leaves.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("a"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    everywhere = (total["b"] + 1) / (total["a"] + total["b"] + 2) if total["a"] + total["b"] else 0.0
    at = leaves.select("host", "merged").distinct().select("host", "merged", F.explode(_prefixes(F.col("merged"))).alias("p")).select("host", "merged", "p.level", "p.node")
    branch = at.join(nodes, ["host", "node"]).groupBy("host", "merged").agg(F.sort_array(F.collect_list(F.struct("level", "allowed", "blocked"))).alias("branch"))
    share = F.aggregate("branch", F.lit(everywhere), lambda p, x: (x["blocked"] + F.lit(WEIGHT) * p) / (x["allowed"] + x["blocked"] + F.lit(WEIGHT)))
    return branch.select("host", "merged", share.alias("blocked_share"))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict (the rule's, else the template's), template, blocked_share."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    places = saved(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("shape", shape(F.col("path"))), "places")
    known = saved(ruled(places, rules), "rulings")
    count = lambda verdict: F.sum(F.when(F.col("ruling") == verdict, F.col("n")).otherwise(0))
    shapes = saved(known.groupBy("host", "shape").agg(F.sum("n").alias("n"), count("allow").alias("allowed"), count("block").alias("blocked")), "shapes")
    leaves = saved(merged(templates(shapes)), "leaves")
    shares = leaves.select("host", "shape", "merged").join(judged(leaves), ["host", "merged"])
    decided = saved(shares.select("host", "shape", F.col("merged").alias("template"), "blocked_share"), "decided")
    verdict = F.coalesce("ruling", F.when(F.col("blocked_share") > BLOCKED, "block").otherwise("allow"))
    by_place = saved(known.join(decided, ["host", "shape"]).select("host", "path", "rule", verdict.alias("verdict"), "template", "blocked_share"), "verdicts")
    return rows.join(by_place, ["host", "path"]).select(key, "host", "path", "rule", "verdict", "template", "blocked_share")
