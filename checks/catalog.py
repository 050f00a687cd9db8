"""Importing this module registers every query."""

from checks import bundles, insight, loads, operators, records, repairs, stored, trips, views  # noqa: F401
