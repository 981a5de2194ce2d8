"""tidemark: a Spark-first analytics engine over relational sales tables."""

__version__ = "0.1.0"
