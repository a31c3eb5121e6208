"""citelens: a PySpark-native engine for analysing how papers use observatory missions."""
