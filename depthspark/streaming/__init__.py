"""Structured Streaming forms: the stateful order book, message rates and the feed."""
