"""lorequarry: a PySpark-native knowledge-analytics engine."""
__version__ = "0.1.0"
