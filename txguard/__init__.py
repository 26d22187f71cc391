"""txguard — card-transaction anomaly analytics on Spark.

Batch features, scoring, evaluation, analyst queries and a Structured
Streaming scoring job, all expressed with the DataFrame API.
"""

__version__ = "0.1.0"
