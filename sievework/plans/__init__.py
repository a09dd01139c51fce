"""Helpers that shape how a plan runs: staging, lineage cuts, graph closure."""
