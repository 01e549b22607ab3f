"""Sources and sinks: collections, files, reports."""
