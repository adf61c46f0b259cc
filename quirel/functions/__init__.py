"""Part of the quirel engine."""
