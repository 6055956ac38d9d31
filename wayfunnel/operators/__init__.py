"""Operators of the wayfunnel library."""
