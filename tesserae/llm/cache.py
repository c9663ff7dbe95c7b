"""A bounded cache in two generations: what is used again survives, the rest goes."""

from __future__ import annotations


class Generations:
    """At most 2 * limit entries.  `young` may be read directly; put() and old_get() do the rest."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def old_get(self, key):
        """Value in the old generation, brought back to the young one, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            # the same dict object stays young, so that callers may hold it
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value
