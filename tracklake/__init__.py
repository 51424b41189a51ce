"""tracklake: Spark-native analytics over tracks, scenes, annotations and text."""
