"""Event-intelligence analytics operators for PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function on the public
Spark API.  Clocks are parameters, undefined ratios are NULL, and each top-k
has a total order.
"""
