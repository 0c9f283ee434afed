"""traceloom: Spark-native analytics over predicted and observed program behaviour."""

__version__ = "0.1.0"
