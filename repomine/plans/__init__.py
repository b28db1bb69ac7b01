"""Whole queries, and the queries the driver runs."""
