"""Structured Streaming forms of the detectors (T1-T6) and the live flow source (S3)."""
