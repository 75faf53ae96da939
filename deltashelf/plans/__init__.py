"""Queries over the driver's tables, each beside the SQL that checks it."""
