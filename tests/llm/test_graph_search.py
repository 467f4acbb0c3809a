import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import graph_search as G
from tests.conftest import SF001

KIND = "vec_id bigint, embedding array<float>, VEC_ID string, score double, shard int, vector string, embedding string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], KIND)


def exact(rows, k, every):
    """The k nearest by comparing all pairs; scores summed from the first coordinate on."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            usable[i, tuple(np.float32(v).astype(float))] = None
    out = {}
    for i, q in usable:
        if i % every == 0:
            near = []
            for j, v in usable:
                if j != i and len(v) == len(q):
                    s = 0.0
                    for a, b in zip(q, v):
                        s += a * b
                    near.append((-s, j))
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = [len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items() if w]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, scaled):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 24))
    if scaled:
        x *= rng.uniform(.2, 3, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(G.nearest(table(spark, rows), p=G.GraphParams(shard_rows=250, block=20)))
    want = exact(rows, 20, 20)
    assert recall(got, want) >= .95
    truth = {(i, j): s for i, w in exact(rows, 900, 20).items() for j, s in w}
    for i, near in got.items():
        assert [(j, s) for j, s in near] == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20
        assert all(s == truth[i, j] for j, s in near)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []),
           (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.5]), (160, [1.0, 0.0]), (3, [-1.0, 0.0])]
    want = {0: [(2, 2.0), (1, 1.0), (160, 1.0), (3, -1.0)], 160: [(2, 2.0), (0, 1.0), (1, 1.0), (3, -1.0)]}
    assert answers(G.nearest(table(spark, odd))) == want == {i: w for i, w in exact(odd, 20, 20).items() if w}
    assert G.nearest(table(spark, [])).collect() == []
    assert G.nearest(table(spark, odd[1:4])).collect() == []


def test_a_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [3.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    got, want = answers(G.nearest(table(spark, rows), p=G.GraphParams(shard_rows=100))), exact(rows, 20, 20)
    assert got[0] == want[0] == [(j, 72.0) for j in range(3, 63, 3)]
    assert recall(got, want) >= .95


def test_recall_on_the_given_table(spark):
    t = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    want = exact(rows, 20, 20)
    assert recall(answers(G.nearest(t)), want) >= .9
    assert recall(answers(G.nearest(t, p=G.GraphParams(shard_rows=100))), want) >= .9


def test_pruning_keeps_diverse_edges():
    x = np.float32([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]])
    ids = np.array([[1, 2, 3, 4, -1, 0]])
    dist = G.distances(x[:1], x[np.maximum(ids, 0)])
    dist[ids < 0] = np.inf
    kept = G.robust_prune(x, np.array([0]), ids, dist, 3, 1.2)
    assert kept.tolist() == [[1, 3, 4]]  # 2 lies behind 1


def test_index_holds_every_vector_once(spark):
    rows = G.usable(spark.range(200).select("id", F.array(F.col("id") % 50 + 1.0, F.lit(1.0)).alias("vector")))
    index = G.build_index(rows, 20, G.GraphParams(shard_rows=20)).collect()
    assert len(index) == 50 and sorted(i for r in index for i in r.ids) == list(range(200)) and len({r.shard for r in index}) > 1
