"""Retrieval plans and their compilation."""
