"""Plan-level helpers: scratch tables that cut lineage, checked broadcasts, session defaults."""

from tessera.plans.scratch import Scratch, broadcast_if_small, shared_root
from tessera.plans.session import prepare

__all__ = ["Scratch", "broadcast_if_small", "prepare", "shared_root"]
