"""DataFrame operators for alarm and event journals."""
