"""Procurement-intelligence analytics expressed as Spark DataFrame operators."""
