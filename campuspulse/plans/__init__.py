"""Registered queries, each with an independent SQL twin where SQL can say it."""
