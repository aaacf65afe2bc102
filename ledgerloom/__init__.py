"""Escrow reconciliation analytics expressed as Spark DataFrame transformations."""
