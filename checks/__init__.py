"""Registered queries, each with an independent SQL statement where SQL can express it."""
