"""Column expressions: repeatable hashing, feature engineering, rule scores."""
