"""Spark-native multimodal graph retrieval and question-answering analytics."""
