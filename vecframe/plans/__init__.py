"""vecframe.plans."""
