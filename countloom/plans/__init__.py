"""Registered queries: each module pairs a Spark query with the SQL that gives the same rows."""
