"""What is known of a record's attempts, as a state that merges in any order.

A state holds the attempts up to the first one that stops the record, each once. Merging two states takes the union, of
an attempt that both have the greater entry, and drops what comes after the first stop. So merging is associative and
commutative, and a state merged with itself stays as it is: partial results of tasks, late rows and repeated rows all
lead to the same outcome.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

SLOT = ("ts", "outcome", "prediction_label", "reasoning", "error_message", "wait_seconds")
Slot = tuple


def _rank(slot: Slot) -> tuple:
    """Order of entries of one attempt: as structs compare, with nulls first."""
    return tuple((x is not None, 0 if x is None else x) for x in slot)


@dataclass
class Entry:
    """An attempt: whether it stops the record, and its values in the order of ``SLOT``."""

    stops: bool
    slot: Slot

    def with_other(self, other: Entry) -> Entry:
        if self.slot == other.slot and self.stops == other.stops:
            return self
        return Entry(self.stops or other.stops, max(self.slot, other.slot, key=_rank))


class Outcome:
    """Runs over the attempts of a record in order, in constant memory."""

    def __init__(self) -> None:
        self.made, self.last, self.error, self.wait, self.stopped = 0, None, None, 0, False

    def take(self, attempt: int, entry: Entry) -> None:
        if self.stopped:
            return
        self.made, self.last, self.stopped = attempt, entry.slot, entry.stops
        *_, error, wait = entry.slot
        self.error = self.error if error is None else error
        self.wait += wait or 0

    def values(self, success: str) -> tuple:
        """Label, reasoning, success, attempts made, time, error, wait and outcome."""
        ts, outcome, label, reasoning, _, _ = self.last
        return label, reasoning, outcome == success, self.made, ts, self.error, self.wait, outcome


class AttemptFold:
    """The state of one record."""

    def __init__(self) -> None:
        self.entries: dict[int, Entry] = {}
        self.stop: int | None = None

    def add(self, attempt: int, entry: Entry) -> None:
        if self.stop is not None and attempt > self.stop:
            return
        held = self.entries.get(attempt)
        self.entries[attempt] = entry = entry if held is None else held.with_other(entry)
        if entry.stops and (self.stop is None or attempt < self.stop):
            self.stop = attempt
            self.entries = {a: e for a, e in self.entries.items() if a <= attempt}

    def merge(self, other: AttemptFold) -> None:
        for attempt, entry in other.entries.items():
            self.add(attempt, entry)

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        return iter(sorted(self.entries.items()))

    def __len__(self) -> int:
        return len(self.entries)

    def outcome(self) -> Outcome:
        out = Outcome()
        for attempt, entry in self:
            out.take(attempt, entry)
        return out

    def dump(self) -> bytes:
        return json.dumps([[a, e.stops, *e.slot] for a, e in self], separators=(",", ":")).encode()

    @classmethod
    def load(cls, data: bytes) -> AttemptFold:
        fold = cls()
        for attempt, stops, *slot in json.loads(data):
            fold.add(attempt, Entry(stops, tuple(slot)))
        return fold
