"""wayfold: Spark-native tables, views and reports over agent runs."""
