"""equitext: Spark-native operators for measuring and reducing identity bias
in text classifiers.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
keeps its work on the executors.  See README.md for the operator map.
"""

__version__ = "0.1.0"
