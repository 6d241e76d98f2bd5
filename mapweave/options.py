"""Conversion options, normalised once and folded into the plan as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """complete: all features instead of the first relation's bare geometry; tagged: also referenced elements with tags; exclude_ways: but not referenced ways.

    strict: a null vertex is an error of its document, instead of dropping out;
    by_document: whole documents are dealt to tasks, else their elements are.
    """

    complete: bool = False
    tagged: bool = False
    exclude_ways: bool = True
    strict: bool = False
    by_document: bool = True

    @classmethod
    def of(cls, options: Options | Mapping | None) -> Options:
        """From a mapping with completeFeature, renderTagged, excludeWay, strictGeometry and byDocument; only an absent excludeWay or byDocument means true."""
        if isinstance(options, Options):
            return options
        given = options or {}
        exclude = bool(given["excludeWay"]) if "excludeWay" in given else True
        return cls(bool(given.get("completeFeature")), bool(given.get("renderTagged")), exclude, bool(given.get("strictGeometry")), bool(given.get("byDocument", True)))
