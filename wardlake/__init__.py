"""wardlake: a Bronze / Silver / Gold analytics library for hospital operations
data, written as Spark DataFrame plans."""

__version__ = "0.1.0"
