"""All queries and their SQL, registered by importing the query modules."""

from tilewright.plans import q_aggs, q_draws, q_joins, q_models, q_rows, q_sources  # noqa: F401
from tilewright.plans.registry import QUERIES, SQL  # noqa: F401
