"""Plans of the typed-delta engine."""
