"""tessera: a Spark-native analytics engine for reproducible empirical studies.

Operators take DataFrames (with optional grouping keys) and return DataFrames; nothing but sizes,
one-row summaries and bounded models ever reaches the driver.
"""

__version__ = "0.1.0"
