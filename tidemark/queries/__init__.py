"""Queries over a directory of tables: each takes (spark, sf_dir) and returns a DataFrame."""
