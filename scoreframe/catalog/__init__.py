"""Registered queries: every operator run over the given tables, with its SQL check."""

from .registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
