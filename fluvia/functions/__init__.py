"""Column functions without Python UDFs."""
