"""Stores of time-indexed tables and the readers that feed them."""
