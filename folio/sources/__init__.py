"""Sources and sinks: files, exports, the history log."""
