"""cairnlake: a Spark-first engine for conversational memory tables.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (registered
queries with their SQL twins) and ``streaming`` (Structured Streaming).
"""

__version__ = "0.1.0"
