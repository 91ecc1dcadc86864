"""Operators over DataFrames: graph, search, text, time, resolution, rollup, lifecycle, ontology."""
