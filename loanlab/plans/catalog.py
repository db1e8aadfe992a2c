"""All registered queries (importing a module registers its queries)."""

from loanlab.plans import (  # noqa: F401
    data_quality_queries, decision_queries, evaluate_queries, feature_queries, learn_queries, monitor_queries,
    prepare_queries, profile_queries, warehouse_queries,
)
from loanlab.plans.registry import ORACLES, QUERIES  # noqa: F401
