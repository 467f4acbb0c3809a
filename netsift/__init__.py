"""netsift: network-flow threat analytics as Spark DataFrame / SQL operators.

Layout
------
- ``sources``    flow / packet / feed readers, built-in indicator tables, sinks
- ``functions``  column-expression helpers (IP predicates, domain features, text)
- ``operators``  flow queries, detectors, indicators, reputation, anomaly, graph, metering
- ``plans``      detector registry, the full analysis plan, the query catalog
- ``streaming``  Structured Streaming forms of the detectors and metering
"""

from netsift.schema import ALERT_SCHEMA, FLOW_SCHEMA
from netsift.session import get_spark, scratch_dir

__all__ = ["ALERT_SCHEMA", "FLOW_SCHEMA", "get_spark", "scratch_dir"]
__version__ = "0.1.0"
