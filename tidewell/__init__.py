"""Spark-native analytics for collections of regulatory documents."""
