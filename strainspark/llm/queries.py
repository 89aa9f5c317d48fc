"""Registered queries of the problems solved in this subpackage."""

from strainspark.llm import q_canonical, q_langid, q_leaks, q_mixing, q_pairs, q_topn

QUERIES, SQL = {}, {}
for module in (q_pairs, q_topn, q_canonical, q_leaks, q_mixing, q_langid):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
