"""Operators on samples, spans and predictions as DataFrame transformations."""
