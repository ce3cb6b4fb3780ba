"""glossmill: the data side of supervised entity and relation extraction, as Spark DataFrame operators."""

__version__ = "0.1.0"
