"""A bounded memory of what one Python worker has worked out for distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Remembered:
    """Values by key, in two generations.

    New keys of a batch are worked out together.  When the young generation is
    full it becomes the old one; a key that is met again moves back to the young,
    and what was not met for a whole generation is forgotten.  Frequent words thus
    are worked out once, and memory stays below twice ``size`` and one batch.
    """

    def __init__(self, learn: Callable[[set], Iterable[tuple]], size: int):
        self.learn, self.size = learn, size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        """The key's value, if it is remembered."""
        value = self.young.get(key)
        return self.old.get(key) if value is None else value

    def of(self, batch: Iterable[Iterable]) -> dict:
        """A dictionary that holds at least the keys of the lists in ``batch``."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = set().union(*batch)
        new.difference_update(young)
        if new and old:
            young.update([(k, old[k]) for k in new if k in old])
            new.difference_update(young)
        if new:
            young.update(self.learn(new))
        return young
