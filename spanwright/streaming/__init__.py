"""Structured Streaming forms of the evaluator."""
