"""Structured Streaming into stores, and windows over streams."""
