"""Colour of a heat-map cell from its count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32 key colours (red, green, blue) of the public viridis map.
VIRIDIS_KEYS = (
    (0.267003985, 0.004872566, 0.329415069),
    (0.277228998, 0.051716984, 0.37694991),
    (0.28247969, 0.097334964, 0.419510575),
    (0.282711276, 0.139317688, 0.456197068),
    (0.278092635, 0.179895883, 0.486377421),
    (0.269137787, 0.219429659, 0.50989087),
    (0.256733532, 0.257754383, 0.52718378),
    (0.242031461, 0.294643816, 0.539209024),
    (0.226243756, 0.329989329, 0.547162826),
    (0.210443168, 0.363856061, 0.552221276),
    (0.195412486, 0.396435844, 0.555350926),
    (0.181477325, 0.428017314, 0.557198854),
    (0.168574228, 0.458905237, 0.55806733),
    (0.156365949, 0.489384598, 0.557941172),
    (0.144535294, 0.519685615, 0.556527663),
    (0.133249552, 0.549958247, 0.553339219),
    (0.123833067, 0.580259243, 0.547771637),
    (0.119442112, 0.610546221, 0.53918201),
    (0.124881902, 0.640695014, 0.526954942),
    (0.144277738, 0.670499732, 0.510554716),
    (0.178281445, 0.699705646, 0.489567134),
    (0.224797439, 0.72801441, 0.463677887),
    (0.281243458, 0.755097766, 0.432683204),
    (0.345693489, 0.780604757, 0.396465689),
    (0.416705432, 0.80418531, 0.355029985),
    (0.493228829, 0.825506231, 0.308497657),
    (0.574270238, 0.844288831, 0.257257704),
    (0.658654029, 0.860389968, 0.202434461),
    (0.744780537, 0.873933018, 0.147547821),
    (0.830610047, 0.885437755, 0.10427358),
    (0.91400241, 0.895811264, 0.100134278),
    (0.993248149, 0.906154763, 0.143935944),
)

# Line colours of an overlay, used in turn.
OVERLAY_COLORS = ("LIGHT_BLUE", "LIGHT_RED", "LIGHT_GREEN", "LIGHT_YELLOW", "LIGHT_GRAY")


def color_position(count: Column, low: Column, high: Column) -> Column:
    """Place of a count on the colour scale, 0 to 31; 0 when the scale has no extent."""
    share = (count.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(high > low, share).otherwise(F.lit(0.0)) * F.lit(float(len(VIRIDIS_KEYS) - 1))


def channel(position: Column, which: int) -> Column:
    """One colour channel, 0 to 255: single-precision mix of the two keys around ``position``."""
    keys = F.array(*[F.lit(key[which]).cast("float") for key in VIRIDIS_KEYS])
    below = F.floor(position).cast("int")
    above = F.least(below + F.lit(1), F.lit(len(VIRIDIS_KEYS) - 1))
    fraction = (position - F.floor(position)).cast("float")
    mixed = F.get(keys, below) + fraction * (F.get(keys, above) - F.get(keys, below))
    level = mixed * F.lit(255.0).cast("float")
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), level.cast("double")))).cast("int")
