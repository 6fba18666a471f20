"""functions of the tacet engine."""
