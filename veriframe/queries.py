"""All queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

from veriframe.plans import image_queries, label_queries, text_queries

QUERIES = {**text_queries.QUERIES, **label_queries.QUERIES, **image_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **label_queries.ORACLE_SQL, **image_queries.ORACLE_SQL}
