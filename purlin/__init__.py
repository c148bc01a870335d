"""purlin: a PySpark-native analytics engine for building-information data."""

__version__ = "0.1.0"
