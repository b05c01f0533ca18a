"""All registered queries.  Importing this module fills the registry."""

from surveyspark.plans import q_clean  # noqa: F401
from surveyspark.plans import q_profile  # noqa: F401
from surveyspark.plans import q_model  # noqa: F401
from surveyspark.plans import q_gates  # noqa: F401
from surveyspark.plans import q_ml  # noqa: F401
from surveyspark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
