"""Whole plans: validation of measured subjects, extraction from pages, cleaning and measurement planning."""
