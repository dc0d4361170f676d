"""Queries over the driver's tables, each with equivalent SQL where SQL can say it."""
