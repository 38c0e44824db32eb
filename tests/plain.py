"""Plain versions that the Spark forms are held against."""

from parlance.operators.movement import LIMIT


class Events:
    """The events told so far, each by one row; an index of words finds them.

    A row tells a known event if its signature is that of a told row, or a single
    word of one.  A phrase around a told single word tells that event better and
    takes its slot.  Of several known events the earliest slot counts.
    """

    def __init__(self):
        self.rows: list[int] = []
        self.exact: dict[tuple[str, ...], int] = {}
        self.inside: dict[str, int] = {}  # word -> first slot that holds it
        self.alone: dict[str, int] = {}  # word -> slot told by this word only

    def tell(self, row: int, signature: tuple[str, ...]) -> None:
        never = len(self.rows)
        known = min(self.exact.get(signature, never), self.inside.get(signature[0], never) if len(signature) == 1 else never)
        wider = min((self.alone[w] for w in signature if w in self.alone), default=never) if len(signature) > 1 else never
        if known < min(wider, never):
            return
        slot = wider
        if slot == never:
            self.rows.append(row)
        else:
            self.rows[slot] = row
            single = next(w for w in signature if self.alone.get(w) == slot)
            del self.alone[single], self.exact[single,]
        self.exact.setdefault(signature, slot)
        for w in signature:
            self.inside[w] = min(slot, self.inside.get(w, slot))
        if len(signature) == 1:
            self.alone[signature[0]] = slot


def one_row_an_event(signatures: list[tuple[str, ...]], limit: int = LIMIT) -> list[int]:
    """Indexes of the rows kept, by slot; ``signatures`` come in rank order."""
    events = Events()
    for row, signature in enumerate(signatures):
        events.tell(row, signature)
        if len(events.rows) == limit:
            break
    return events.rows
