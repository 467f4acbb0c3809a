"""The domain model's queries read the flows once for their names; scores are taken of names, not of flows."""

from conftest import SF0001, flows_df

from netsift.operators import domain_model as dm
from netsift.plans import catalog


def test_the_curve_and_the_split_do_not_read_the_flows_again(spark):
    for name in ("domain_rule_evaluation", "domain_model_split"):
        plan = catalog.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "l_partkey" not in plan, name


def test_labelled_domains_of_odd_flows(spark):
    rows = [dict(requested_server_name=n) for n in ("a.xyz", "a.xyz", "b.org", None, "")]
    got = sorted(tuple(r) for r in dm.labelled_domains(flows_df(spark, rows)).collect())
    assert got == [("", 0.0), ("a.xyz", 1.0), ("b.org", 0.0)]
    assert dm.labelled_domains(flows_df(spark, rows[3:4])).count() == 0
