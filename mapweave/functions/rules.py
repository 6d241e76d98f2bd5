"""Which tags make a closed way an area."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys, and the values that make or break an area, must equal the reference's for the same results.
AREA_KEYS = (
    "building", "landuse", "amenity", "leisure", "area", "boundary", "place", "shop", "tourism", "historic",
    "public_transport", "office", "building:part", "military", "ruins", "area:highway", "craft", "golf", "indoor",
)
ONLY = {
    "highway": ("services", "rest_area", "escape", "elevator"),
    "waterway": ("riverbank", "dock", "boatyard", "dam"),
    "barrier": ("city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"),
    "railway": ("station", "turntable", "roundhouse", "platform"),
    "power": ("plant", "substation", "generator", "transformer"),
}
EXCEPT = {
    "natural": ("coastline", "cliff", "ridge", "arete", "tree_row"),
    "man_made": ("cutline", "embankment", "pipeline"),
    "aeroway": ("taxiway",),
}


def tag_verdict(k: Column, v: Column) -> Column:
    """True or false where the key has a rule, else null."""
    out = F.when(k.isin(*AREA_KEYS), F.lit(True))
    for key, values in ONLY.items():
        out = out.when(k == key, v.isin(*values))
    for key, values in EXCEPT.items():
        out = out.when(k == key, ~v.isin(*values))
    return out


def is_area(tags: Column) -> Column:
    """The verdict of the last tag that has a rule; without one, false."""
    verdicts = F.filter(F.transform(tags, lambda t: tag_verdict(t["k"], F.coalesce(t["v"], F.lit("")))), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(verdicts, F.lit(-1)), F.lit(False))


_ALWAYS = frozenset(AREA_KEYS)


def area_of(tags: Iterable[tuple[str, str | None]]) -> bool:
    """``is_area`` of tags in Python."""
    area = False
    for k, v in tags:
        if k in _ALWAYS:
            area = True
        elif k in ONLY:
            area = (v or "") in ONLY[k]
        elif k in EXCEPT:
            area = (v or "") not in EXCEPT[k]
    return area
