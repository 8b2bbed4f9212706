"""Tesserae: a Spark-first engine for storing, linking and retrieving short text records."""
