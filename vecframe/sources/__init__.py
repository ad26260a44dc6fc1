"""vecframe.sources."""
