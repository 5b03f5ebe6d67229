"""Spark jobs for payment-transaction risk data: splits, features, tokens, heads, metrics."""
