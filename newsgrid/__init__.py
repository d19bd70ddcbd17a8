"""A Spark-native analytics engine for local news, with operators for training-data pipelines."""
