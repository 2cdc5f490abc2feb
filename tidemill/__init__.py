"""Incremental, partition-aware dataset pipelines on Spark."""
