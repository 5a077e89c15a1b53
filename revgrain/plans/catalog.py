"""Everything that is registered."""

from revgrain.plans.registry import ORACLES, QUERIES, SURVEY_IDS  # noqa: F401
from revgrain.plans import code_plans, contract_plans, data_plans, eval_plans, review_plans, scalar_plans, search_plans  # noqa: F401
