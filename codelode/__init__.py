"""PySpark-native code intelligence and corpus engine."""
