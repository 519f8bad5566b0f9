"""Operators of the typed-delta engine."""
