"""Whole plans: the wide one-minute table, and the registered queries with their SQL twins."""
