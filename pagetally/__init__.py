"""Counting and auditing documents across monthly collections of scanned files, on Spark."""
