"""Sources of examples."""
