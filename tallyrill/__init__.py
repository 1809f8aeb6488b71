"""tallyrill: a Spark-first engine for tool-call security data and large event and text corpora."""

__version__ = "0.1.0"
