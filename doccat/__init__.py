"""doccat: a PySpark-native document catalog engine.

Landed semi-structured lists and raw web pages become one typed catalog; every
operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, windows and joins.
"""

__version__ = "0.1.0"
