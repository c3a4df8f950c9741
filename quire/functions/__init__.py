"""Part of quire: functions."""
