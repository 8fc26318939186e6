"""A PySpark-native evidence engine for versioned item collections."""

__version__ = "0.1.0"
