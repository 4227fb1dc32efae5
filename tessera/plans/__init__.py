"""Plans over several tables: run matrices, commits, the wide view."""
