"""longstats: tidy, reconciled tables from long-format statistics files, on Spark.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame
operators and the cleaning job's stages), ``sources`` (readers/writers),
``plans`` (the assembled job, the derived fixture, the query registry),
``streaming`` (incremental landing of delimited drops).
"""

__version__ = "0.1.0"
