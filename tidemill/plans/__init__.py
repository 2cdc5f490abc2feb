"""Stages, their graph, staleness and the runner."""
