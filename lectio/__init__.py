"""Spark jobs that build, search and study annotated text corpora."""
