"""Weekly commercial analytics on Spark: star schema, KPIs and decision reports."""

__version__ = "0.1.0"
