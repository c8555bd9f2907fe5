"""loomspan: a Spark-first analytics engine for mirrored media metadata.

Everything is expressed with DataFrames and Spark SQL; Arrow-batched Python
is used only where an algorithm is inherently sequential.
"""

__version__ = "0.1.0"
