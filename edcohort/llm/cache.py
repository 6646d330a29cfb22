"""A bounded cache for use inside a task."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """key -> ``make(key)``, made once while the key stays in use.

    Holds two generations of at most ``size`` keys. A full young generation
    becomes the old one; a key found there moves back to the young one. So
    memory is bounded and frequent keys stay."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.add(key, value)
        return value

    def add(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
