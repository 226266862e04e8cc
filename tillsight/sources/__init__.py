"""Readers: test tables, fixtures, raw uploads, landing folders, registry."""
from .tables import Tables
from .fixtures import dirty_from_star, messages_from_part, sales_from_star

__all__ = ["Tables", "dirty_from_star", "messages_from_part", "sales_from_star"]
