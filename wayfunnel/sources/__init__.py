"""Sources of the wayfunnel library."""
