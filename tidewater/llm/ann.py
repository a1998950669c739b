"""Approximate nearest neighbours: one hierarchical navigable small-world graph for each shard, results merged.

Vectors with equal components are one node, which keeps its smallest vec_ids (a search never needs more of them than it
returns, and one for the query itself). Nodes are dealt to shards by hash, so a shard has about SHARD_ROWS of them. A shard's
graph is built in batches: a batch's nodes search the graph so far together, see each other by brute force, choose diverse
neighbours, and are linked back. Each layer is a flat array of neighbours, -1 where there are fewer. Largest inner product is
turned into nearest vector by one more component, which brings all nodes to the same length.

An index is a table with one row for each shard. A search sends blocks of queries to every shard, and a copy of the shard to each
of its blocks, which are as large as a shard: copies grow with the queries only as the queries do. It scores what it finds exactly in double precision on the original vectors, and keeps the best over all shards.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose size is not the most
usual one. Rows that share a vec_id and vector are one. Null vec_ids take no part. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import saved

#: Links of a node in upper layers and in the lowest, and the width of searches while building and searching.
LINKS, LOWEST_LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 32, 64, 96
SHARD_ROWS, QUERY_BLOCK, BATCH = 8192, 8192, 512


def usable(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    d = vector.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(d, lambda x: x != 0)


def _distances(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of points[ids] (rows x n) to `to` (rows x dimensions); infinite where the id is -1."""
    diff = points[np.maximum(ids, 0)]
    out = np.einsum("rnd,rnd->rn", diff, diff) - 2 * np.einsum("rnd,rd->rn", diff, to) + np.einsum("rd,rd->r", to, to)[:, None]
    return np.where(ids >= 0, out, np.inf)


def search_layer(points: np.ndarray, links: np.ndarray, to: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the nearest nodes found for each row of `to`, nearest first, -1 where there are fewer.

    All rows take a step together: each opens its nearest node not yet opened, until none is left among its `width` nearest.
    """
    rows = np.arange(len(to))
    seen = np.zeros((len(to), len(points) + 1), bool)  # the last column is for -1
    seen[rows[:, None], entry] = True
    ids = np.full((len(to), width), -1, np.int64)
    ids[:, : entry.shape[1]] = entry
    far = _distances(points, ids, to)
    opened = np.zeros(ids.shape, bool)
    live = rows
    while len(live):
        open_to = np.where(opened[live] | (ids[live] < 0), np.inf, far[live])
        best = open_to.argmin(1)
        more = np.isfinite(open_to[np.arange(len(live)), best])
        live, best = live[more], best[more]
        if not len(live):
            break
        opened[live, best] = True
        new = links[ids[live, best]]
        new = np.where(seen[live[:, None], new], -1, new)
        seen[live[:, None], new] = True
        seen[:, -1] = False
        all_ids = np.concatenate([ids[live], new], 1)
        all_far = np.concatenate([far[live], _distances(points, new, to[live])], 1)
        all_open = np.concatenate([opened[live], np.zeros(new.shape, bool)], 1)
        keep = np.argpartition(all_far, width - 1, 1)[:, :width]
        ids[live], far[live], opened[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_far, all_open))
    order = np.argsort(far, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def choose(points: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` diverse neighbours of each row from candidates ids, nearest first: one is passed over if it is nearer
    to a chosen one than to the row's own node; those passed over fill what is left."""
    order = np.argsort(far, 1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    ids = np.where(np.isfinite(far), ids, -1)
    twice = np.zeros(ids.shape, bool)
    by_id = np.argsort(ids, 1, kind="stable")
    sorted_ids = np.take_along_axis(ids, by_id, 1)
    np.put_along_axis(twice, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    usable_ = (ids >= 0) & ~twice
    vectors = points[np.maximum(ids, 0)]
    squares = np.einsum("rnd,rnd->rn", vectors, vectors)
    taken, passed = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool)
    shadow = np.full(ids.shape, np.inf)  # distance to the nearest chosen one
    for j in range(ids.shape[1]):
        ok = usable_[:, j] & (taken.sum(1) < most)
        pick = ok & (shadow[:, j] >= far[:, j])
        taken[:, j], passed[:, j] = pick, ok & ~pick
        if pick.any():
            to = vectors[pick, j]
            d = squares[pick] - 2 * np.einsum("rnd,rd->rn", vectors[pick], to) + squares[pick, j][:, None]
            shadow[pick] = np.minimum(shadow[pick], d)
    rank = np.where(taken, 0, np.where(passed, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(points: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """Enter `nodes` among the links of their neighbours, which choose anew if they have too many."""
    most = links.shape[1]
    source = np.repeat(nodes, most)
    target = links[nodes].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    each, first, counts = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(each), BATCH):
        t, f, c = each[a : a + BATCH], first[a : a + BATCH], counts[a : a + BATCH]
        added = np.full((len(t), int(c.max())), -1, np.int64)
        column = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        added[np.repeat(np.arange(len(t)), c), column] = source[f[0] : f[0] + c.sum()]
        ids = np.concatenate([links[t], added], 1)
        links[t] = choose(points, ids, _distances(points, ids, points[t]), most)


def build_graph(points: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Neighbour arrays (nodes x links) of each layer, the lowest first. Nodes 0, 1, ... of a layer are all those of the next, so layers share ids."""
    n = len(points)
    sizes = [n]
    while sizes[-1] > 4 * LINKS:
        sizes.append(max(1, sizes[-1] // LINKS))
    layers = []
    for level, size in enumerate(sizes):
        links = np.full((size, LOWEST_LINKS if level == 0 else LINKS), -1, np.int64)
        layers.append(links)
    done = 0
    while done < n:
        upto = min(n, done + min(BATCH, max(32, done)))
        nodes = np.arange(done, upto)
        entry = np.zeros((len(nodes), 1), np.int64)
        for level in range(len(layers) - 1, -1, -1):
            links = layers[level]
            here = nodes[nodes < len(links)]
            if done:
                found, far = search_layer(points, links, points[nodes], entry, BUILD_WIDTH if len(here) else 8)
                entry = found[:, :1]
            if not len(here):
                continue
            mates = np.broadcast_to(here, (len(here), len(here)))
            mates = np.where(mates == here[:, None], -1, mates)
            near = _distances(points, mates, points[here])
            best = np.argsort(near, 1)[:, : LOWEST_LINKS]
            ids, dist = np.take_along_axis(mates, best, 1), np.take_along_axis(near, best, 1)
            if done:
                ids, dist = np.concatenate([found[: len(here)], ids], 1), np.concatenate([far[: len(here)], dist], 1)
            most = links.shape[1] // 2 if level == 0 else links.shape[1]
            links[here, :most] = choose(points, ids, dist, most)
            _link_back(points, links, here)
        done = upto
    return layers


def search_graph(points: np.ndarray, layers: list[np.ndarray], to: np.ndarray, width: int) -> np.ndarray:
    entry = np.zeros((len(to), 1), np.int64)
    for links in layers[:0:-1]:
        entry = search_layer(points, links, to, entry, 4)[0][:, :1]
    return search_layer(points, layers[0], to, entry, width)[0]


def nodes_of(vectors: DataFrame, key: str, vector: str, copies: int) -> DataFrame:
    """name (of the vector), v (double array), ids (its smallest `copies` keys, ascending)."""
    found = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    # adding zero turns a negative zero into zero
    named = found.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("name", F.md5(F.to_json("v"))).dropDuplicates(["id", "name"])
    size = named.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    named = named.filter(F.size("v") == (size["size"] if size else 0))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("rank") <= copies)
    return ranked.groupBy("name").agg(F.min_by("v", "rank").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, names, vectors, ids, layers: one row for each shard."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("name").reset_index(drop=True)  # names are hashes: their order is as good as a shuffle
        v = np.stack(frame["v"].to_numpy())
        lengths = (v * v).sum(1)
        points = np.concatenate([v, np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]], 1).astype(np.float32)
        layers = build_graph(points)
        flat = [x.astype("<i4").tobytes() for x in layers]
        return pd.DataFrame({"shard": [int(frame["shard"][0])], "n": [len(v)], "vectors": [v.astype("<f8").tobytes()], "ids": [frame["ids"].tolist()], "layers": [flat], "extra": [points[:, -1].astype("<f4").tobytes()]})

    # a range of shards each, so that no task builds several while others are idle
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")
    return dealt.groupBy("shard").applyInPandas(build, "shard int, n long, vectors binary, ids array<array<long>>, layers array<binary>, extra binary")


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """name, found: for each query (name, v) the best k candidates of every shard as (score, id), k for each shard."""
    shards = [r["shard"] for r in index.select("shard").collect()]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.lit(shards).cast("array<int>") if shards else F.array().cast("array<int>")))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            row = right.iloc[0]
            n = int(row["n"])
            v = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
            points = np.concatenate([v, np.frombuffer(row["extra"], "<f4")[:, None]], 1).astype(np.float32)
            layers = [np.frombuffer(x, "<i4").astype(np.int64) for x in row["layers"]]
            layers = [x.reshape(-1, LINKS if level else LOWEST_LINKS) for level, x in enumerate(layers)]
            q = np.stack(left["v"].to_numpy()).astype(np.float64)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                to = np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32)
                ids = search_graph(points, layers, to, min(width, max(n, 1)))
                scores = np.einsum("rnd,rd->rn", v[np.maximum(ids, 0)], part)
                for name, i, s in zip(left["name"][a : a + 256], ids, scores, strict=True):
                    pool = [(-float(x), int(key)) for node, x in zip(i, s, strict=True) if node >= 0 for key in row["ids"][node]]
                    best = sorted(pool)[:k]
                    out.append((name, [{"score": -x, "id": key} for x, key in best]))
        return pd.DataFrame(out, columns=["name", "found"])

    return asked.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(search, "name string, found array<struct<score:double,id:long>>")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose key is divisible by `every`, among all other rows."""
    nodes = saved(nodes_of(vectors, key, vector, k + 1), "nodes")
    index = saved(build_index(nodes, shard_rows), "index")
    rows = vectors.filter(F.col(key) % every == 0)
    asked = rows.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    asked = asked.select("query_id", F.md5(F.to_json("v")).alias("name")).distinct()
    queries = nodes.join(asked.select("name").distinct(), "name", "left_semi").select("name", "v")
    found = search_index(index, queries, k + 1).select("name", F.inline("found"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    own = asked.join(lists, "name").select("query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
