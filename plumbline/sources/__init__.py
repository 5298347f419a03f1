"""Point sources and sinks."""
