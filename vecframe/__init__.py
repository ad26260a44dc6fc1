"""vecframe: embedding-corpus preparation, vector top-k search, recall/latency evaluation
and retrieval reporting, expressed as Spark DataFrame / SQL / Structured Streaming plans."""

__version__ = "0.1.0"
