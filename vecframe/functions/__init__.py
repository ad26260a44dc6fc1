"""vecframe.functions."""
