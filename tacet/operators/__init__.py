"""operators of the tacet engine."""
