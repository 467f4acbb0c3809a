"""Plans: detector registry, full analysis, query catalog and SQL oracle."""
