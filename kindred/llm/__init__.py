"""Operators and the pipeline that prepare training data for language models."""
