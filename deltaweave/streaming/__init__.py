"""Streaming of the typed-delta engine."""
