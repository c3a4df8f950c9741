"""Part of quire: sources."""
