"""skarn: a Spark-first engine for code and document intelligence."""

__version__ = "0.1.0"
