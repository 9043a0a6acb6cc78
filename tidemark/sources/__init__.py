"""Sources and sinks: test tables, JSON lines, versioned tables."""
