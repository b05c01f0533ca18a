"""surveyspark: survey cleaning, labelling, quality gates, model metrics and
fairness audits as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a function
returning a small result table) meant to be chained with
``DataFrame.transform``.  Configuration lives in :mod:`surveyspark.spec`.
"""

from surveyspark.spec import SurveySpec, CHILD_SURVEY, DRIVER_TABLES

__all__ = ["SurveySpec", "CHILD_SURVEY", "DRIVER_TABLES"]
__version__ = "0.1.0"
