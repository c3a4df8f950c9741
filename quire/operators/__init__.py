"""Part of quire: operators."""
