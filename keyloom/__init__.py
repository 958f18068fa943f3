"""Keyloom: a PySpark-native analytics engine for keyed, path-addressed tables."""
