"""What operators keep in a Python worker from task to task.

Workers are reused by all operators of a session.  One that starts takes its cache from here
and empties those of the others, so that a worker holds the words of one operator, not of all
that ever ran in it.
"""

from __future__ import annotations

import gc

import pyarrow as pa

_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """The owner's cache in this process."""
    others = [c for name, c in _CACHES.items() if name != owner and c]
    for c in others:
        c.clear()
    if others:
        gc.collect()  # a cache and the model that fills it know each other
        pa.default_memory_pool().release_unused()
    return _CACHES.setdefault(owner, {})
