"""The catalogue of runnable queries and their SQL counterparts."""
