"""Operators: flow queries, detectors, indicator tables, reputation, anomaly, graph, metering."""
