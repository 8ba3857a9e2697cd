"""PySpark-native record linkage and data-processing engine."""
