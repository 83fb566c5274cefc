"""rollbook: record-keeping analytics (grade books and similar tables) on Spark.

Every operator takes and returns a ``DataFrame``; column names and thresholds are
parameters, with the grade-book defaults documented next to each function.
"""

__version__ = "0.1.0"
