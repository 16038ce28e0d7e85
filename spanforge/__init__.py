"""Conversation attribution analytics as PySpark operators."""
