"""quirel: a PySpark-native document processing engine."""
