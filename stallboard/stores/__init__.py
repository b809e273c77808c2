"""Stored tables that later loads add to: published versions, keyed inserts, daily state, indexes."""
