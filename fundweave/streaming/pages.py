"""Ids of a grouping key in the state store, many to a value."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql.streaming import StatefulProcessorHandle

#: Ids of a page, on average at most.
_IDS = 64


class Pages:
    """A map from ids to small JSON values, kept as pages that a hash of the id names.

    A call of the state store takes as long for a page as for one id, so a trigger costs at
    most a page an id of its own, and far less where it has many. The pages are dealt anew,
    twice as many, whenever they hold too many ids: what a trigger reads does not grow with
    what came before. begin() and end() enclose the work on a key.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.size = handle.getValueState(f"{name}_size", "ids long, bits int")
        self.pages = handle.getMapState(name, "page long", "ids string")

    def begin(self) -> None:
        self.n, self.bits = self.size.get() if self.size.exists() else (0, 0)
        self.had, self.open, self.changed = self.n > 0, {}, set()

    def _read(self, page: int) -> dict:
        if page not in self.open:
            stored = self.had and self.pages.containsKey((page,))
            self.open[page] = json.loads(self.pages.getValue((page,))[0]) if stored else {}
        return self.open[page]

    def _page(self, ident: str) -> int:
        return zlib.crc32(ident.encode()) & ((1 << self.bits) - 1)

    def get(self, ident: str):
        return self._read(self._page(ident)).get(ident)

    def put(self, ident: str, value) -> None:
        page = self._page(ident)
        ids = self._read(page)
        self.n += ident not in ids
        ids[ident] = value
        self.changed.add(page)

    def items(self) -> Iterator[tuple]:
        for page in range(1 << self.bits):
            yield from list(self._read(page).items())

    def remove(self, ident: str) -> None:
        page = self._page(ident)
        self.n -= self._read(page).pop(ident, None) is not None
        self.changed.add(page)

    def end(self) -> None:
        if self.n > _IDS << self.bits:
            every, old = list(self.items()), range(1 << self.bits)
            while self.n > _IDS << self.bits:
                self.bits += 1
            self.open = {page: {} for page in range(1 << self.bits)}
            for ident, value in every:
                self.open[self._page(ident)][ident] = value
            self.changed = {*old, *(page for page, ids in self.open.items() if ids)}
        for page in self.changed:
            if self.open[page]:
                self.pages.updateValue((page,), (json.dumps(self.open[page]),))
            elif self.had and self.pages.containsKey((page,)):
                self.pages.removeKey((page,))
        if self.changed:
            self.size.update((self.n, self.bits))
