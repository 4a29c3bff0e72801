"""Terrane: schema-evolution analytics expressed as Spark plans."""
