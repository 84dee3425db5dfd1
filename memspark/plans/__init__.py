"""Whole flows that chain operators."""
