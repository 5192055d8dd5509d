"""A changelog engine on Spark: row-level change events in, table state, SQL text and envelopes out."""
