"""tallyloom: retail sales analytics as lazy Spark DataFrame plans.

Every public function takes DataFrames (plus plain arguments) and returns a
lazy DataFrame; nothing is collected to the driver. Layout:

- ``sources``   open shop tables, result reuse, exports
- ``functions`` column expressions (rule-id parsing, buckets, predicates)
- ``operators`` reusable distributed building blocks (top-k, joins, stats)
- ``plans``     the named queries and analytics built from the above
"""

__version__ = "0.1.0"
