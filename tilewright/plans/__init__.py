"""Whole jobs, the views that stand in for a dataset, and the query catalogue."""
