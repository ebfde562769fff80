"""Whole runs, and the operators as queries over the driver tables."""
