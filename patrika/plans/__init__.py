"""Queries: operators applied to whole tables, and the SQL they are checked with."""
