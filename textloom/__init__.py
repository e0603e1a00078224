"""Spark-native textual collation: token tables, alignment, variants, graphs and their renderings."""
