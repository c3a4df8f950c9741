"""Part of quire: streaming."""
