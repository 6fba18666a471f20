"""plans of the tacet engine."""
