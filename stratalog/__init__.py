"""Spark-native log-evidence triage: discover, decode, match, aggregate and report on log bundles with DataFrames."""
