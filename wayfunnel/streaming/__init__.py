"""Streaming of the wayfunnel library."""
