"""A PySpark-native engine for time-sensitive security news, exploitation catalogues and their operational logs."""
