"""A bounded cache whose entries expire."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class ExpiringCache:
    """At most ``size`` entries, each for ``ttl`` seconds; the entry that was stored first goes first."""

    def __init__(self, size: int = 2048, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self._held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()

    def get(self, key: Hashable) -> Any | None:
        found = self._held.get(key)
        if found is None:
            return None
        if self.clock() - found[0] >= self.ttl:
            del self._held[key]
            return None
        return found[1]

    def put(self, key: Hashable, value: Any) -> None:
        self._held.pop(key, None)
        self._held[key] = (self.clock(), value)
        while len(self._held) > self.size:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)
