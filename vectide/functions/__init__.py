"""Part of the directional-evidence engine."""
