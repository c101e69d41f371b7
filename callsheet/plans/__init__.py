"""Named queries over the test tables, each with its oracle SQL when SQL can
express it. Importing this package fills the registry."""

from callsheet.plans import embedding_queries, explore_queries, learner_queries, ml_queries, model_queries, segment_queries  # noqa: F401
from callsheet.plans.registry import REGISTRY, oracle_sqls, spark_queries

__all__ = ["REGISTRY", "oracle_sqls", "spark_queries"]
