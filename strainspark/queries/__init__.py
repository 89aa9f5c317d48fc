"""Registered queries: each module has QUERIES (name to function) and SQL (name to text)."""

from strainspark.queries import evidence, files, joins, periods, ranked, reports, strings

MODULES = [periods, ranked, strings, joins, files, evidence, reports]
