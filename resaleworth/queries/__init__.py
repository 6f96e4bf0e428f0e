"""Runnable queries over the test tables, one per operator, and the SQL they are checked against."""
