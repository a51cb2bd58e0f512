"""mnemo: a Spark-native engine for long-lived text memory and training-data pipelines."""
