"""cliplane: a Spark-native analytics engine for short-video content."""
