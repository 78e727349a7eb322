"""DataFrame -> DataFrame operators over log entries."""
