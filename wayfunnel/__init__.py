"""wayfunnel: Spark-native recommendation-funnel analytics.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver unless it is a bounded summary (a handful of aggregate values).
"""

from wayfunnel.session import build_session, written

__all__ = ["build_session", "written"]
