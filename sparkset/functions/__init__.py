"""Column expressions: features and casts, answers, conversations, preferences, row shapes."""
