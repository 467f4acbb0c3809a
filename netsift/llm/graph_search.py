"""Approximate nearest neighbours by a robust-pruned directed graph (operator 12).

Distinct vectors are dealt to shards of bounded size by their hash. Each shard
holds a directed graph: vectors are inserted in growing batches, a greedy
search over the graph so far proposes neighbours, and relaxed distance pruning
keeps those that no kept one is ``alpha`` times nearer to; kept edges are added
the other way too, and lists that grow too long are pruned again. The graphs
are a table (shard, node, vector, ids, neighbours), one row per vector. A beam
search takes each query through the graph of every shard, and the best of all
shards are the result.

Nearness is the largest inner product. A coordinate that fills every vector up
to the shard's largest length makes it the smallest distance, so graphs serve
vectors of any length. Scores are computed on the original vectors in double
precision, summed from the first coordinate to the last.

Equal vectors are one node. It carries its ``k + 1`` smallest ids: of rows that
tie, only those can be among the k nearest, so a vector that a third of all
rows share costs one node and nothing is lost. Searches of many queries are
run side by side, in blocks of bounded size that meet one shard at a time.

Rows whose vector is null, empty, zero or holds a null or non-finite component
take no part, nor do rows without an id. Rows that agree in id and vector count
once; differing vectors under one id all take part, none of them as a neighbour
of that id. Vectors of different dimensions never meet. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import narrow, stored


@dataclass(frozen=True)
class GraphParams:
    #: Vectors of a shard, about; a shard is built and searched in one task's memory.
    shard_rows: int = 8192
    #: Out-edges of a node.
    degree: int = 32
    #: Candidates that a build search and a query's search keep.
    build_beam: int = 64
    search_beam: int = 96
    alpha: float = 1.2
    #: Queries that meet a shard at once.
    block: int = 4096


# -- one shard ---------------------------------------------------------------------------------------------------------

def filled(x: np.ndarray) -> np.ndarray:
    """One more coordinate, by which all rows get the length of the longest."""
    sq = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))]).astype(np.float32)


def distances(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of row i of ``a`` (n, d) to each of ``x`` (n, m, d)."""
    diff = x - a[:, None, :]
    return np.einsum("nmd,nmd->nm", diff, diff)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes met on the way (-1: fewer) and their distances, nearest first.

    All queries take their next step at once; each expands its nearest node not
    expanded yet until its beam holds no such node.
    """
    n, nodes = len(queries), len(x)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = distances(queries, np.broadcast_to(x[start], (n, 1, x.shape[1])))[:, 0]
    seen = np.zeros((n, nodes), bool)
    seen[:, start] = True
    active = np.arange(n)
    while len(active):
        first = np.argmin(done[active], axis=1)  # beams are sorted, so the first open one is the nearest
        at = ids[active, first]
        done[active, first] = True
        near = edges[at]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        rows, cols = np.nonzero(fresh)
        seen[active[rows], near[rows, cols]] = True
        far = np.full(near.shape, np.inf, np.float32)
        diff = x[near[rows, cols]] - queries[active[rows]]
        far[rows, cols] = np.einsum("ij,ij->i", diff, diff)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        dist[active] = np.take_along_axis(all_dist, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
        active = active[~done[active].all(axis=1)]
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` of its candidates (-1: none): the nearest, then the nearest that none kept shadows."""
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    open_ = (ids >= 0) & (ids != nodes[:, None])
    vectors = x[np.maximum(ids, 0)]
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for j in range(degree):
        more = open_.any(axis=1)
        if not more.any():
            break
        pick = np.argmax(open_, axis=1)
        out[more, j] = ids[rows, pick][more]
        between = distances(vectors[rows, pick], vectors)
        shadowed = alpha * alpha * between <= dist
        open_ &= ~(shadowed & more[:, None])
        open_[rows, pick] = False
    return out


def unique_candidates(ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same candidates, a repeated one put out of reach."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return np.where(again, -1, ids), np.where(again | (ids < 0), np.inf, dist).astype(np.float32)


def build_graph(x: np.ndarray, p: GraphParams) -> tuple[np.ndarray, int]:
    """Out-edges (-1: none) of each row of ``x`` and the node to start from, the one nearest the mean."""
    n = len(x)
    edges = np.full((n, p.degree), -1, np.int64)
    mean = x.mean(axis=0, keepdims=True, dtype=np.float64).astype(np.float32)
    start = int(np.argmin(((x - mean) ** 2).sum(axis=1)))
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 1
    while done < n:
        batch = order[done:done + size]
        ids, dist = beam_search(x, edges, start, x[batch], p.build_beam)
        chosen = robust_prune(x, batch, ids, dist, p.degree, p.alpha)
        edges[batch] = chosen
        add_reverse(x, edges, batch, chosen, p)
        done += len(batch)
        size = min(2 * size, max(16, n // 16), 512)
    return edges, start


def add_reverse(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, chosen: np.ndarray, p: GraphParams) -> None:
    """Each chosen neighbour gets an edge back; lists that overflow are pruned."""
    rows, cols = np.nonzero(chosen >= 0)
    to, back = chosen[rows, cols], batch[rows]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    have = (edges[nodes] >= 0).sum(axis=1)
    fits = have + counts <= p.degree
    place = np.arange(len(to)) - np.repeat(first, counts)
    ok = np.repeat(fits, counts)
    edges[to[ok], (place + np.repeat(have, counts))[ok]] = back[ok]
    over = np.flatnonzero(~fits)
    if len(over):
        width = int(counts[over].max())
        extra = np.full((len(over), width), -1, np.int64)
        which = np.repeat(np.cumsum(~fits) - 1, counts)
        extra[which[~ok], place[~ok]] = back[~ok]
        ids = np.concatenate([edges[nodes[over]], extra], axis=1)
        dist = distances(x[nodes[over]], x[np.maximum(ids, 0)])
        ids, dist = unique_candidates(ids, dist)
        edges[nodes[over]] = robust_prune(x, nodes[over], ids, dist, p.degree, p.alpha)


# -- all shards --------------------------------------------------------------------------------------------------------

def usable(rows: DataFrame) -> DataFrame:
    """(id, vector) that take part, each once."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0)).filter(finite) \
        .filter(F.exists("vector", lambda v: v != 0)).distinct()


def build_index(rows: DataFrame, k: int, p: GraphParams = GraphParams()) -> DataFrame:
    """The stored graphs (dims, shard, node, vector, ids, start, neighbours) of ``usable`` rows (id, vector)."""
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1) \
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    nodes = stored(nodes.withColumn("dims", F.size("vector")), "vectors")
    shards = nodes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / p.shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dims") \
        .withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))  # shards: a row per dimension

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ids", key=lambda s: s.map(lambda v: v[0])).reset_index(drop=True)
        edges, start = build_graph(filled(np.array(f["vector"].tolist(), np.float64)), p)
        return pd.DataFrame({"dims": f["dims"], "shard": f["shard"], "node": np.arange(len(f)), "vector": f["vector"], "ids": f["ids"],
                             "start": start, "neighbours": pd.Series([e[e >= 0] for e in edges], dtype=object)})

    return stored(dealt.select("dims", "shard", "vector", "ids").groupBy("dims", "shard").applyInPandas(
        run, "dims int, shard int, node int, vector array<double>, ids array<bigint>, start int, neighbours array<int>"), "graphs")


def shard_answers(nodes: pd.DataFrame, queries: pd.DataFrame, k: int, p: GraphParams) -> Iterator[tuple]:
    """(query_id, query, vec_id, score) of the ``k`` best rows of a shard for each of its queries."""
    nodes = nodes.sort_values("node")
    x = np.array(nodes["vector"].tolist(), np.float64)
    edges = np.full((len(x), p.degree), -1, np.int64)
    for i, e in enumerate(nodes["neighbours"]):
        edges[i, :len(e)] = e
    ids, start, space = nodes["ids"].tolist(), int(nodes["start"].iloc[0]), filled(x)
    asked = np.array(queries["vector"].tolist(), np.float64)
    beam = min(max(p.search_beam, k + 1), len(x))
    step = max(16, min(512, (1 << 22) // len(x)))
    for s in range(0, len(asked), step):
        q = asked[s:s + step]
        wide = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        found, _ = beam_search(space, edges, start, wide, beam)
        candidates = x[np.maximum(found, 0)]
        score = np.zeros(found.shape)
        for j in range(x.shape[1]):
            score += q[:, j, None] * candidates[:, :, j]
        for row, (i, v) in enumerate(zip(queries["id"].iloc[s:s + step], queries["place"].iloc[s:s + step])):
            best = [(-sc, vec) for node, sc in zip(found[row].tolist(), score[row].tolist()) if node >= 0
                    for vec in ids[node] if vec != i]
            for sc, vec in sorted(best)[:k]:
                yield i, v, vec, -sc


def search(index: DataFrame, queries: DataFrame, k: int, p: GraphParams = GraphParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (id, vector): their ``k`` nearest, ties to the smaller id."""
    queries = stored(queries.withColumn("dims", F.size("vector")).withColumn("place", F.xxhash64("vector")), "queries")
    blocks = queries.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"))
    shards = index.groupBy("dims").agg((F.max("shard") + 1).alias("shards"))
    sizes = F.broadcast(blocks.join(shards, "dims"))  # a row per dimension
    asked = queries.join(sizes, "dims").select(
        "dims", F.pmod(F.xxhash64("id", "place"), F.col("blocks")).cast("int").alias("block"), "id", "place", "vector",
        F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"))
    graphs = index.join(sizes, "dims").select("dims", "shard", "node", "vector", "ids", "start", "neighbours",
                                              F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))

    def run(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows = list(shard_answers(nodes, wanted, k, p)) if len(nodes) and len(wanted) else []
        return pd.DataFrame(rows, columns=["query_id", "place", "vec_id", "score"])

    keys = ["dims", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id bigint, place bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    once = found.distinct()  # an id may stand under several vectors of a tie
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            p: GraphParams = GraphParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row whose id is divisible by ``every``."""
    rows = stored(usable(narrow(rows, id=(vec_id, "bigint"), vector=(embedding, "array<double>"))), "usable")
    return search(build_index(rows, k, p), rows.filter(F.col("id") % every == 0), k, p)
