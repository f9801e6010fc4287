"""Part of ledgerlens."""
