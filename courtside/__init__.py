"""DataFrame operators for entity-by-event analytics on Spark."""
