"""Part of rowanmill."""
