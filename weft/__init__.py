"""Weft: labelled-graph reachability and corpus operators on Spark DataFrames."""
