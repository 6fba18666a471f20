"""streaming of the tacet engine."""
