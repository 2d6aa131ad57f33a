"""Event-search analytics expressed as Spark DataFrame operators."""
