"""All registered queries; importing a module registers its queries."""

from tallystone.plans import cdc, io, products, recon, scalars  # noqa: F401
from tallystone.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
