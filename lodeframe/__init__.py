"""lodeframe: a PySpark-native relational engine with a fluent query builder."""

__version__ = "0.1.0"
