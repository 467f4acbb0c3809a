"""The forest as full binary trees gives the path lengths of the node table."""

import numpy as np
import pandas as pd

from netsift.operators import iforest as ifo


def _by_node(x, nodes):
    total = np.zeros(len(x))
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        rows = t.to_dict("records")
        for i, r in enumerate(x):
            n = rows[0]
            while n["feature"] >= 0:
                n = rows[n["left"] if r[n["feature"]] < n["threshold"] else n["right"]]
            total[i] += n["depth"] + ifo.c_factor([n["size"]])[0]
    return total / nodes["tree"].nunique()


def test_full_trees_equal_the_walk_over_nodes():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)  # many equal values, some on thresholds
    cols = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
    nodes = pd.DataFrame([n for t in range(7) for n in ifo.grow_tree(x[rng.permutation(300)[:64]], t, 42, 6)], columns=cols)
    on = nodes[nodes["feature"] >= 0].iloc[:4]
    x[:4, 0] = on["threshold"]  # equal to a threshold: to the right
    assert np.array_equal(ifo._path_lengths(x, ifo.Forest.of(nodes)), _by_node(x, nodes))
    one = pd.DataFrame(ifo.grow_tree(np.ones((5, 4)), 0, 42, 3), columns=cols)  # a leaf alone
    assert np.array_equal(ifo._path_lengths(x, ifo.Forest.of(one)), _by_node(x, one))
    assert len(ifo._path_lengths(x[:0], ifo.Forest.of(nodes))) == 0


def test_scores_do_not_carry_columns_that_nobody_reads(spark):
    from conftest import SF0001
    from netsift.sources.flows import load_tables
    flows = load_tables(spark, SF0001).flows
    plan = ifo.predict(flows, ifo.fit(flows, n_estimators=5)).select("dst_port", "anomaly_score")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "user_agent" not in plan
