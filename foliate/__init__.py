"""Spark-native analytics over long documents: readers, chunking, entities, typed questions, belief curves."""
