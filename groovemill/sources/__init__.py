"""Readers and the domain views over the driver's tables."""
