"""binsight: Spark-native analytics for streams of discarded items.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``); I/O lives in ``binsight.sources`` and ``binsight.streaming``.
"""

__version__ = "0.1.0"
