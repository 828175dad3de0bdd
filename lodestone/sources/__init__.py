"""Readers and writers of records, and models."""
