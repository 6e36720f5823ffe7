"""Structured Streaming: pages to facts and charts as they arrive, and windowed counts of events."""
