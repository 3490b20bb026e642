"""Queries over archives of blocks, transactions and event logs, as Spark plans."""
