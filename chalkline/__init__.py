"""Spark jobs for textbook retrieval, prompt building, response parsing and quiz grading."""

__version__ = "0.1.0"
