"""A PySpark-native engine to prepare, mix, segment, pack and evaluate multimodal corpora."""
