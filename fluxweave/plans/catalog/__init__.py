"""All registered queries."""

from fluxweave.plans.catalog import files, matrices, models, streams, vectors
from fluxweave.plans.catalog.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "files", "matrices", "models", "streams", "vectors"]
