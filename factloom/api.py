"""The commands that remote callers may use, with their arguments held to safe ranges. Results are lists of plain rows."""

from __future__ import annotations

from typing import Any

from factloom.functions import fixed
from factloom.store import Store

#: Rows that a call returns by default and at most, and characters of a query that are read.
DEFAULT_LIMIT, MOST_ROWS, QUERY_CHARS = 5, 50, 1000


def clamped(limit: object, default: int = DEFAULT_LIMIT) -> int:
    """A limit in 1..50; the default for what is no number."""
    try:
        return max(1, min(int(limit), MOST_ROWS))  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return default


class Facade:
    """recall, search, recent, prefetch, add and supersede over a store."""

    def __init__(self, store: Store) -> None:
        self.store = store

    @staticmethod
    def _rows(df: Any) -> list[dict]:
        return [r.asDict() for r in df.collect()]

    def recall(self, query: str, namespace: str | None = None, limit: object = None, include_global: bool = True) -> list[dict]:
        return self._rows(self.store.recall(query[:QUERY_CHARS], namespace, clamped(limit), include_global))

    def search(self, query: str, namespace: str | None = None, limit: object = None) -> list[dict]:
        return self._rows(self.store.search(query[:QUERY_CHARS], namespace, clamped(limit, 10)))

    def recent(self, namespace: str, limit: object = None, include_global: bool = False) -> list[dict]:
        return self._rows(self.store.recent(namespace, clamped(limit), include_global=include_global))

    def prefetch(self, query: str, namespace: str, limit: object = None) -> list[dict]:
        """What a prompt would recall, without counting it; prompts under five characters recall nothing."""
        if len(query.strip()) < 5:
            return []
        return self._rows(self.store.recall(query[:QUERY_CHARS], namespace, clamped(limit), True, no_bump=True))

    def add(self, namespace: str, content: str, type: str = "fact", tags: str = "", signal: str = "none", confidence: float | None = None) -> dict:  # noqa: A002
        """The counts of the ingest; what comes from afar is captured in auto mode."""
        if len(content) > fixed.CONTENT_CHARS:
            raise ValueError("the content is too long")
        return self.store.add(namespace, type, content, tags, confidence=confidence, signal=signal, capture_mode="auto").first().asDict()

    def supersede(self, id: str, reason: str = "") -> bool:  # noqa: A002
        """Whether a live row had that id."""
        found = not self.store.get(id).filter("superseded_at is null").isEmpty()
        if found:
            self.store.supersede(id, reason)
        return found
