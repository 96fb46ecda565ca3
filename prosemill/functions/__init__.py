"""Part of prosemill."""
