import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from netsift.session import get_spark
    s = get_spark("local[4]", app="netsift-tests", shuffle_partitions=4)
    yield s
    s.stop()


def flows_df(spark, rows):
    """Build a flow frame from partial dicts; missing columns are NULL."""
    from netsift.schema import FLOW_SCHEMA
    from netsift.sources.flows import conform
    full = [{f.name: r.get(f.name) for f in FLOW_SCHEMA.fields} for r in rows]
    return conform(spark.createDataFrame(full, FLOW_SCHEMA))
