"""Part of quire: plans."""
