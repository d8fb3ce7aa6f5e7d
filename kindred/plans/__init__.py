"""Whole jobs: ingestion, preparation, models, recommendation, quality."""
