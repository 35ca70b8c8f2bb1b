"""lodeframe: a PySpark-native analytics library for site, claim, parcel and document data."""

__version__ = "0.1.0"
