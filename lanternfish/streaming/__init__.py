"""Event-time counterparts of the batch operators."""
