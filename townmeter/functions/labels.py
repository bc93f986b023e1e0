"""Rounding, bands, codes and label lists."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small letters that Unicode decomposes into a plain letter and marks, of the Latin, Greek and Cyrillic blocks and their extensions.
_BARE = {c: d[0] for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:])) and not unicodedata.combining(d[0])}
_MARKED, _PLAIN = "".join(_BARE), "".join(_BARE.values())
# Upper ends of the elevation bands in metres, and stops of the summer heat scale in degrees.
BANDS = ((200, "<200 m"), (600, "200–600 m"), (1000, "600–1000 m"))
TOP_BAND = "≥1000 m"
HEAT_STOPS = (21.0, 24.0, 26.5, 29.0, 32.0)
#: Differences below the first are similar, from the second on they are clear.
SIMILAR, CLEAR = 0.5, 2.0


def round_up(value: Column, digits: int = 0) -> Column:
    """Rounding half toward plus infinity, unlike round(), which goes away from zero."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale


def plain(name: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks of their own; ligatures stay."""
    return F.regexp_replace(F.translate(F.lower(name), _MARKED, _PLAIN), "[\u0300-\u036f]", "")


def department(code: Column) -> Column:
    """Department of a place code: its first two characters, three overseas."""
    return F.when(code.startswith("97"), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2))


def elevation_band(metres: Column) -> Column:
    out = F.when(metres.isNull(), F.lit(None).cast("string"))
    for top, label in BANDS:
        out = out.when(metres < top, label)
    return out.otherwise(TOP_BAND)


def elevation_order(metres: Column) -> Column:
    """Ordinal of the band, as labels don't sort by height."""
    out = F.when(metres.isNull(), F.lit(None).cast("int"))
    for i, (top, _) in enumerate(BANDS):
        out = out.when(metres < top, i)
    return out.otherwise(len(BANDS))


def tie_band(value: Column, origin: Column, same: Column) -> Column:
    """How a place's summer compares with the origin's; null for the origin itself or a missing value."""
    d = value - origin
    return (
        F.when(same | d.isNull(), F.lit(None).cast("string"))
        .when(F.abs(d) < SIMILAR, "similar")
        .when(d <= -CLEAR, "clearly cooler").when(d < 0, "cooler")
        .when(d >= CLEAR, "clearly warmer").otherwise("warmer")
    )


def signed(value: Column, digits: int = 1) -> Column:
    """A number with its sign and fixed digits; null stays null."""
    return F.concat(F.when(value >= 0, "+").otherwise("-"), F.format_string(f"%.{digits}f", F.abs(value)))


def label_list(*labels: tuple[Column, Column | str], separator: str = ", ", none: str = "none") -> Column:
    """The labels whose condition holds, joined; `none` if there are none."""
    found = F.array_compact(F.array(*[F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in labels]))
    return F.when(F.size(found) > 0, F.array_join(found, separator)).otherwise(none)


def heat_class(value: Column) -> Column:
    """Number of scale stops that a summer mean reaches, 0 to 5."""
    return sum((F.when(value >= s, 1).otherwise(0) for s in HEAT_STOPS), F.lit(0)) + F.when(value.isNull(), F.lit(None).cast("int")).otherwise(0)


def date10(stamp: Column) -> Column:
    """The date part of a longer stamp; null if it has none."""
    return F.when(F.substring(stamp, 1, 10) != "", F.substring(stamp, 1, 10))
