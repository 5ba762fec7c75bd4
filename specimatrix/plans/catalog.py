"""All queries of the library outside the optional subpackage."""

from __future__ import annotations

from specimatrix.plans import reference, training

QUERIES = reference.QUERIES | training.QUERIES
ORACLES = reference.ORACLES | training.ORACLES
