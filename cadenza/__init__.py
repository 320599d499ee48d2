"""Media-catalog and event-timeline analytics as Spark DataFrame operators."""
