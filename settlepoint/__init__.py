"""Convergence analytics over nested event logs, expressed as Spark plans."""
