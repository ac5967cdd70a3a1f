"""Plan-time languages: edit expressions, actions, ranges; and their compilation to DataFrames."""
