"""A Spark-native engine for layered tabular pipelines: Bronze, Silver, Gold, views and serving queries."""
