"""Named query plans: every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from . import edit_queries, function_queries, movie_queries, packet_queries, stream_queries, tree_queries

QUERIES: dict = {}
SQL: dict = {}
for _m in (packet_queries, edit_queries, function_queries, tree_queries, movie_queries, stream_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
