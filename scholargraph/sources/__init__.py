"""Sources and sinks: JSON-lines dumps, the structure register, person tables, reports."""
