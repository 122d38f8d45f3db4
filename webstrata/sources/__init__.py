"""Tables, page and asset sources, sinks."""
