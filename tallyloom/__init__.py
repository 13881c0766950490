"""tallyloom: a Spark-native analytics engine for evaluation results."""

__version__ = "0.1.0"
