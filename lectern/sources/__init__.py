"""Sources and sinks: files, tables, schemas."""
