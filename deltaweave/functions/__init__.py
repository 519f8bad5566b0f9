"""Functions of the typed-delta engine."""
