"""Sources and sinks: headerless matrix files, run logs, result tables."""
