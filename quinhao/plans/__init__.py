"""Whole calculations composed from the operators."""
