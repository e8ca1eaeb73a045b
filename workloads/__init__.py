"""Queries over the provided tables, each with the SQL its result must equal."""
