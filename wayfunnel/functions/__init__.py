"""Functions of the wayfunnel library."""
