"""Sources of the typed-delta engine."""
