"""Registered queries, one per operator, with their checking SQL."""

from scriptoria.checks import choosing, cutting, files, formats, geometry, matching, outputs, raster, results, whole  # noqa: F401
from scriptoria.checks.registry import ORACLES, QUERIES, as_query  # noqa: F401
