"""A bounded memo for pure functions of short strings."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """Two generations of at most ``limit`` entries each; what the younger one lacks is looked up in the older.

    ``fill(keys)`` computes the values of a list of distinct keys. Results don't depend on the limit.
    """

    def __init__(self, fill: Callable[[list], list], limit: int = 200_000):
        self.fill, self.limit = fill, limit
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, keys) -> dict:
        """A dictionary that holds at least the values of ``keys``."""
        young = self.young
        missing = set(keys) - young.keys()
        if not missing:
            return young
        if len(young) + len(missing) > self.limit and young:
            self.old, self.young = young, {}
            young, missing = self.young, set(keys)
        unknown = []
        for k in missing:
            v = self.old.get(k)
            if v is None:
                unknown.append(k)
            else:
                young[k] = v
        if unknown:
            young.update(zip(unknown, self.fill(unknown), strict=True))
        return young
