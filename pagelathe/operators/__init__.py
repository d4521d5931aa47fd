"""DataFrame operators over pages and nodes."""
