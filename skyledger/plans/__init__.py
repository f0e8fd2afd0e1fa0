"""Registered queries: adapters from the test tables, Spark queries and their SQL twins."""
