"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from unitloom.proofs import context, facts, relations, rounds, scalars, stores, trees
from unitloom.proofs.registry import PROOFS

__all__ = ["PROOFS", "context", "facts", "relations", "rounds", "scalars", "stores", "trees"]
