"""Window scores: reduction over class sets, and the flags made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class indexes of the public AudioSet ontology by what they stand for.
SPEECH = (0, 4, 6, 7)
SING = (27, 28, 29, 30, 31, 36, 37, 254, 255, 266)
MUSIC = (137, 267, 268, 270)


def class_max(probs: Column, classes: tuple[int, ...]) -> Column:
    """Greatest probability among the classes that the array has; null if it has none."""
    return F.greatest(*[F.get(probs, F.lit(i)).cast("double") for i in classes]) if len(classes) > 1 else F.get(probs, F.lit(classes[0])).cast("double")


def sing_flag(speech: Column, sing: Column, least: float = 0.15) -> Column:
    return (sing > speech) & (sing > least)


def song_flag(speech: Column, sing: Column, music: Column, sing_least: float = 0.15, music_least: float = 0.30, speech_most: float = 0.25) -> Column:
    return sing_flag(speech, sing, sing_least) | ((music > music_least) & (speech < speech_most))


def clean_speech_flag(speech: Column, sing: Column, music: Column, least: float = 0.5, sing_most: float = 0.10, music_most: float = 0.20) -> Column:
    return (speech > least) & (sing < sing_most) & (music < music_most)
