"""Colour features and the rule ladder on 8-bit L*a*b* values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
COLOURS = ["red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "white", "gray", "black"]
NEUTRAL_CHROMA, WHITE_L, BLACK_L, PINK_L = 15.0, 210.0, 50.0, 160.0
BROWN_HUE, BROWN_CHROMA, BROWN_L = 83.0, 45.0, 145.0
HUES = [(51.0, "red"), (84.0, "orange"), (119.0, "yellow"), (220.0, "green"), (315.0, "blue"), (340.0, "purple")]
PINK_UNDER = 16.0


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a - 128.0, b - 128.0)


def hue(a: Column, b: Column) -> Column:
    """Radians."""
    return F.atan2(b - 128.0, a - 128.0)


def features(light: Column, a: Column, b: Column) -> Column:
    return F.array(light, a, b, chroma(a, b), hue(a, b))


def name_by_rules(light: Column, a: Column, b: Column) -> Column:
    degrees = F.degrees(hue(a, b))
    around = F.when(degrees < 0, degrees + 360).otherwise(degrees)
    strength = chroma(a, b)
    neutral = F.when(light > WHITE_L, "white").when(light < BLACK_L, "black").otherwise("gray")
    warm = F.when(light >= PINK_L, "pink").otherwise("red")
    by_hue = F.when((around >= HUES[-1][0]) | (around < PINK_UNDER), warm)
    for top, name in HUES:
        by_hue = by_hue.when(around < top, name)
    brown = (around < BROWN_HUE) & (strength < BROWN_CHROMA) & (light < BROWN_L)
    return F.when(strength < NEUTRAL_CHROMA, neutral).when(brown, "brown").otherwise(by_hue)
