"""The registered queries and their SQL."""

from corpusloom.plans import line_queries, work_queries

QUERIES: dict = {**line_queries.QUERIES, **work_queries.QUERIES}
ORACLES: dict[str, str] = {**line_queries.ORACLES, **work_queries.ORACLES}
