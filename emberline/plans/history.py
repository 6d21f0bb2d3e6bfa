"""Which sets of facts a propagation has fired for."""

from __future__ import annotations


class History:
    """Firings by rule name and set of fact ids, whatever their order."""

    def __init__(self):
        self._seen: dict[str, set[tuple[int, ...]]] = {}

    def add(self, rule: str, ids) -> bool:
        """False if it was there already."""
        seen, key = self._seen.setdefault(rule, set()), tuple(sorted(ids))
        new = key not in seen
        seen.add(key)
        return new

    def has(self, rule: str, ids) -> bool:
        return tuple(sorted(ids)) in self._seen.get(rule, ())

    def not_in(self, rule: str, ids) -> bool:
        return not self.has(rule, ids)

    def clear(self) -> None:
        self._seen.clear()

    def snapshot(self) -> dict[str, list[str]]:
        """Ids joined by colons, sorted as strings."""
        return {rule: sorted(":".join(map(str, k)) for k in keys) for rule, keys in self._seen.items()}

    def rows(self):
        return [(rule, list(k)) for rule, keys in self._seen.items() for k in sorted(keys)]
