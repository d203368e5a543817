"""chartspark: a Spark-native analytics engine for music-chart statistics."""
