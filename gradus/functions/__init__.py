"""Subpackage of gradus."""
