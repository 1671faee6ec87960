"""Registered queries: a Spark form of each and the SQL that must give the same rows."""
