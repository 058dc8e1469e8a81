"""Spark-native engine that turns untidy product sources into one clean product table."""
