"""Typed property graphs from text, as Spark DataFrame plans."""
