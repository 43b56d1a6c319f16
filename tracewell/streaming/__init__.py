"""Stateless operators on streaming input."""
