"""DataFrame-to-DataFrame operators. Every one is keyed by query_id or user_id and runs for a whole batch."""
