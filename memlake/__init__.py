"""Conversational-memory analytics as Spark DataFrame operators."""
