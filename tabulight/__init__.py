"""tabulight: explain, clean, model and search a set of tables with Spark."""

__version__ = "0.1.0"
