"""Selectors, relaxed union, walk-forward cohorts and set differences."""
