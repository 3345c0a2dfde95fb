"""Registered queries over the benchmark tables, and the SQL that tells what they should return."""
