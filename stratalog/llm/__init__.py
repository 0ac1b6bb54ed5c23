"""Operators for training-data pipelines over text corpora; nothing else in the library imports this subpackage."""
