"""Operators: DataFrame in, DataFrame out.  "today" and "now" are always parameters."""
