"""All registered queries of the reference operators."""

from . import audits, consent, contracts, datasets, divergence, grounding, router, runs, scores, sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
