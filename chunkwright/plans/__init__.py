"""Registered queries over arrays that are encoded from tables."""
