"""Helpers that shape physical plans: shared materialisation and iteration."""
from quernstone.plans.shared import cut, discard, shared_dir, shared_table, writing
from quernstone.plans.ship import map_arrow, ship
from quernstone.plans.sizes import broadcast_few, dealt

__all__ = ["broadcast_few", "cut", "dealt", "discard", "map_arrow", "shared_dir", "shared_table", "ship", "writing"]
