"""Part of lattispark."""
