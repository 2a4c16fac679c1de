"""A PySpark-native analytics engine for spreadsheet-shaped data."""
