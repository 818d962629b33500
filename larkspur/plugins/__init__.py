"""Policies over every operation of a repository."""

from larkspur.plugins.audit import Audit
from larkspur.plugins.cache import Cache, MemoryCache
from larkspur.plugins.compaction import Compaction
from larkspur.plugins.expiry import Expiry
from larkspur.plugins.fulltext import FullText
from larkspur.plugins.softdelete import SoftDelete
from larkspur.plugins.tenancy import Tenancy
from larkspur.plugins.timestamps import Timestamps
from larkspur.plugins.vectors import Vectors

__all__ = ["Audit", "Cache", "Compaction", "Expiry", "FullText", "MemoryCache", "SoftDelete", "Tenancy", "Timestamps", "Vectors"]
