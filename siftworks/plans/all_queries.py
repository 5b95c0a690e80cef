"""All registered queries."""

from siftworks.plans import q_focus, q_graph, q_relate, q_rules, q_stats, q_streams, q_text  # noqa: F401
from siftworks.plans.registry import QUERIES, SQL  # noqa: F401
