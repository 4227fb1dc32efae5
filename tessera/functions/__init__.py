"""Column expressions: texts and identities."""
