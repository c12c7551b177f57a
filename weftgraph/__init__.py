"""Spark-native toolkit for fusing many small knowledge graphs into one."""
