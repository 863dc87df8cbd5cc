"""kinweave: Spark-native analytics for interaction networks, communities, themes and training text."""
