"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from quern.plans import data_queries, eval_queries, graph_queries, mention_queries, pipeline_queries, plan_queries, text_queries

QUERIES = {**data_queries.QUERIES, **text_queries.QUERIES, **graph_queries.QUERIES, **eval_queries.QUERIES, **mention_queries.QUERIES, **plan_queries.QUERIES, **pipeline_queries.QUERIES}
ORACLE = {**data_queries.ORACLE, **text_queries.ORACLE, **graph_queries.ORACLE, **eval_queries.ORACLE, **mention_queries.ORACLE, **plan_queries.ORACLE, **pipeline_queries.ORACLE}
FLAGSHIP = QUERIES["question_pipeline"]
