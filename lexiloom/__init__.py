"""lexiloom: a Spark-first engine for large-scale text-record processing."""

__version__ = "0.1.0"
