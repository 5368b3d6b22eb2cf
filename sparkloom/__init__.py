"""Spark jobs for sales panels, document retrieval and detection data."""
