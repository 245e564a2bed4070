"""Tessera: measurement, feature-vector and text analytics expressed as Spark plans."""
