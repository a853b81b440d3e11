"""Subpackage of threatquery."""
