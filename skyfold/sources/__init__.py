"""Readers and writers of catalog tables and model artifacts."""
