"""Queries over the driver's tables."""

from wayfold.plans import areas, files, judgements, learning, line_joins, lines, networks, places, profiles, rules, series, sites, texts
from wayfold.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "areas", "files", "judgements", "learning", "line_joins", "lines", "networks", "places", "profiles", "rules", "series", "sites", "texts"]
