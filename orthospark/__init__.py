"""A PySpark-native analytics engine for imagery, vector detections and training text."""
