"""Operators and the pipeline for preparing training data at scale."""
