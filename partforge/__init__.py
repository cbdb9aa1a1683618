"""Instruction-data jobs for code-generating models, written as Spark DataFrame operations."""
