"""Sources and sinks: topics, stored tables, bulk text, snapshots, handlers."""
