"""Dataflow graphs and the query catalogue."""
