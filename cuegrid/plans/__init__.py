"""Compositions of operators: streams from tables, replay of a track, song skipping."""
