"""vecframe.operators."""
