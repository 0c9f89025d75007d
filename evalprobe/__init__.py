"""Evaluation of model answers, and preparation of training text, on Spark."""
