"""Search, indexes, quantizers and measures on DataFrames."""
