"""vecframe.streaming."""
