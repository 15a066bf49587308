"""formspark: relational analytics over large corpora of form contracts, on Spark."""

__version__ = "0.1.0"
