"""Sources and sinks: text logs and the versioned store."""
