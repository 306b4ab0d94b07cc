"""Hierarchical structure data on Spark: three levels, ordered index views, graph edges."""
