"""Paths, schemas, bounds and the Avro codec."""
