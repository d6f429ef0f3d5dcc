"""Operators on tracks: spans, units, cues, turns. DataFrame in, DataFrame out."""
