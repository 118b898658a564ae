"""Incidences that arrive over time."""
