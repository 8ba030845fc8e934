"""An addressable priority queue: entries are found by their key, so that they can be changed and taken out."""

from __future__ import annotations

from collections.abc import Hashable, Iterator


class AddressableQueue:
    """A binary heap with the place of each key. Least priority first; priorities are compared as a whole, so ties are settled by what they hold."""

    def __init__(self) -> None:
        self._heap: list[tuple] = []
        self._place: dict[Hashable, int] = {}
        self.peak = 0

    def __len__(self) -> int:
        return len(self._heap)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._place

    def __iter__(self) -> Iterator[Hashable]:
        return (key for _, key in self._heap)

    def priority(self, key: Hashable):
        return self._heap[self._place[key]][0]

    def put(self, key: Hashable, priority) -> None:
        """Adds the key, or changes its priority."""
        at = self._place.get(key)
        if at is None:
            self._heap.append((priority, key))
            self._place[key] = at = len(self._heap) - 1
            self.peak = max(self.peak, len(self._heap))
        else:
            self._heap[at] = (priority, key)
        self._settle(at)

    def remove(self, key: Hashable) -> bool:
        """Takes the key out; False where it isn't in."""
        at = self._place.pop(key, None)
        if at is None:
            return False
        last = self._heap.pop()
        if at < len(self._heap):
            self._heap[at] = last
            self._place[last[1]] = at
            self._settle(at)
        return True

    def top(self) -> tuple:
        """(key, priority) of the first entry."""
        priority, key = self._heap[0]
        return key, priority

    def pop(self) -> tuple:
        """(key, priority) of the first entry, taken out."""
        key, priority = self.top()
        self.remove(key)
        return key, priority

    def _settle(self, at: int) -> None:
        """Moves an entry to where it belongs, up or down."""
        heap, place = self._heap, self._place
        entry = heap[at]
        while at and entry[0] < heap[above := (at - 1) // 2][0]:
            heap[at] = heap[above]
            place[heap[at][1]] = at
            at = above
        while (below := 2 * at + 1) < len(heap):
            if below + 1 < len(heap) and heap[below + 1][0] < heap[below][0]:
                below += 1
            if not heap[below][0] < entry[0]:
                break
            heap[at] = heap[below]
            place[heap[at][1]] = at
            at = below
        heap[at] = entry
        place[entry[1]] = at
