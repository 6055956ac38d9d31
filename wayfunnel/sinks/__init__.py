"""Sinks of the wayfunnel library."""
