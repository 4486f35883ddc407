"""corpusgate: quality checks and maintenance of note corpora on Spark."""

__version__ = "0.1.0"
