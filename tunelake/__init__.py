"""tunelake: Spark-native analytics for instruction-tuning data and model evaluation.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``) so it composes with ``DataFrame.transform``.  Sub-packages:

- ``sources``   readers, writers and path helpers
- ``functions`` column expressions and the few Arrow (pandas) UDFs
- ``operators`` DataFrame -> DataFrame operators (pairs, profiling, metrics, tests, runs)
- ``plans``     derived inputs and the registered queries
- ``streaming`` Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
