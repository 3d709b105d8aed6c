"""Assembled plans: the derived fixture, the cleaning job and the query registry."""
