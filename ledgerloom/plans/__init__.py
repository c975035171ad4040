"""Registered queries: a Spark callable and, where one exists, a SQL twin."""
