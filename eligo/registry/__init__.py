"""Registered queries with their SQL checks."""

from eligo.registry import catalog, ingest, matching, normalize, search, sources
from eligo.registry.common import Registry

REGISTRY = Registry()
for part in (sources, normalize, ingest, search, catalog, matching):
    part.register(REGISTRY)
