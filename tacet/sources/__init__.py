"""sources of the tacet engine."""
