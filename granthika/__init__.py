"""Spark-native engine for ordered book text: sources, operators, functions, plans and streams."""
