"""foliant: a PySpark-native engine for analysing collections of study texts."""
