"""Column expressions: title text, dates, classification."""
