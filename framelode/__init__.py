"""framelode: time-coded media evidence as Spark tables.

Samples, signal events, speech candidates, captions and scenes are plain
DataFrames keyed by recording; every operator is a function
``op(df, ...) -> DataFrame`` that only declares a logical plan.
"""

__version__ = "0.1.0"
