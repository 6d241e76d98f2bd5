"""Documents, their readers, and sinks."""
