"""harborline: PySpark-native analytics for coastal water-level data and for cleaning training data."""
