"""Terralex: Spark DataFrame operators for station time series and text embeddings."""
