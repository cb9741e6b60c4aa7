"""Column functions whose semantics differ from, or are missing in, Spark's own."""
