"""Sources and sinks: flow / packet scans, feed readers, built-in indicators, result sinks."""
