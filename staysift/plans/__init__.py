"""Registered queries over the given tables, each with its check SQL where SQL can say it."""
