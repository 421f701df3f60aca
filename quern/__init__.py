"""Quern: Spark-native condition monitoring, evidence retrieval and their bookkeeping."""
