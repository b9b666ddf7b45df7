"""Operators: graph, dataflow, resolution, planning, statistics, similarity, review, report."""
