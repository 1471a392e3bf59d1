"""A Spark-native engine for screening daily price and volume histories."""
