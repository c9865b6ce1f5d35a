"""segmenta — customer-analytics operators as plain Spark DataFrame jobs.

RFM scoring, lifetime value, seasonality, cohort / weekly retention, churn,
registrations, URL-parameter attribution and step funnels.  Every operator is
a function ``DataFrame(s) + keyword filters -> DataFrame`` built from Spark's
own functions, so Catalyst and AQE plan it and it runs unchanged from
``local[8]`` to a large cluster.
"""

from segmenta.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
