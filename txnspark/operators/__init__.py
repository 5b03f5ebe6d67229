"""DataFrame operators: splits, sampling, ordered scans, tokens, vectors, heads, metrics."""
