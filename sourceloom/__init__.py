"""sourceloom: code graphs and corpus preparation as Spark DataFrame jobs."""

__version__ = "0.1.0"
