"""Admission of decisions under a budget of open risk: a journal folded in order, one book at a time.

Whether a decision is let in depends on those let in before and not yet closed, so a book is read in order.
The batch form sorts each book's events inside its partition and reads them as a stream: what is held is
the open decisions and the ids of closed ones, never a book. The streaming form keeps the same state in
Spark's state store and takes each micro-batch in order of receipt; events older than the last batch of their
book are refused, not reordered.

``events`` has book, received_at, seq, kind (DESIGN, ADMIT, EXIT), decision_id, decided_at, exit_at, expires_at
and risk (whole cents). Of a DESIGN only received_at counts: the first one of a book registers it.
Verdicts for ADMIT, in the order they are looked for: INVALID, NO_DESIGN, UNTIMELY, BAD_EXIT, UNREGISTERED, CLOSED,
REPLAY (the same decision again), REWRITTEN (another one under its id), EXHAUSTED, OVER_BUDGET, ADMITTED; for
EXIT: UNKNOWN, REPLAY, LATE, CLOSED_NOW.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a receipt may lie behind its decision or exit, least seconds until the exit, cents of open risk.
MOST_DELAY, LEAST_HOLD, BUDGET = 120, 60, 10_000

EVENTS = "book string, received_at timestamp_ntz, seq long, kind string, decision_id string, decided_at timestamp_ntz, exit_at timestamp_ntz, expires_at timestamp_ntz, risk long"
VERDICTS = "book string, seq long, kind string, decision_id string, verdict string, open_risk long"
#: Events of one receipt and number are taken by their exit and risk, nulls first.
_ORDER = ("received_at", "seq", "exit_at", "risk")
_NAMES = [part.split()[0] for part in EVENTS.split(", ")]


@dataclass
class Book:
    """What a book knows: when it was registered, its open decisions with their terms, and the closed ones' ids."""

    budget: int = BUDGET
    registered: int | None = None
    open: dict[str, tuple[int, int, int]] = field(default_factory=dict)  # decided_at, exit_at, risk
    closed: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.held = sum(terms[2] for terms in self.open.values())  # kept, not summed again for each event

    def take(self, received: int, kind: str, decision: str | None, decided: int | None, leave: int | None, expires: int | None, risk: int | None) -> tuple[str, int]:
        """The verdict on one event, and the open risk before it; times are microseconds."""
        before = self.held - (self.open[decision][2] if decision in self.open else 0)
        return (self._exit(received, decision) if kind == "EXIT" else self._design(received) if kind == "DESIGN" else self._admit(received, decision, decided, leave, expires, risk, before)), before

    def _design(self, received: int) -> str:
        if self.registered is not None:
            return "REPLAY"
        self.registered = received
        return "REGISTERED"

    def _admit(self, received, decision, decided, leave, expires, risk, before) -> str:
        if decision is None or decided is None or leave is None or risk is None or risk <= 0:
            return "INVALID"
        if self.registered is None:
            return "NO_DESIGN"
        if not 0 <= received - decided <= MOST_DELAY * 1_000_000:
            return "UNTIMELY"
        if leave < decided + LEAST_HOLD * 1_000_000 or (expires is not None and leave > expires):
            return "BAD_EXIT"
        if decided < self.registered:
            return "UNREGISTERED"
        if decision in self.closed:
            return "CLOSED"
        if decision in self.open:
            return "REPLAY" if self.open[decision] == (decided, leave, risk) else "REWRITTEN"
        if before >= self.budget:
            return "EXHAUSTED"
        if before + risk > self.budget:
            return "OVER_BUDGET"
        self.open[decision] = (decided, leave, risk)
        self.held += risk
        return "ADMITTED"

    def _exit(self, received: int, decision: str | None) -> str:
        if decision in self.closed:
            return "REPLAY"
        if decision not in self.open:
            return "UNKNOWN"
        if not 0 <= received - self.open[decision][1] <= MOST_DELAY * 1_000_000:
            return "LATE"
        self.held -= self.open.pop(decision)[2]
        self.closed.add(decision)
        return "CLOSED_NOW"


def _value(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


def _micros(x) -> int | None:
    return None if _value(x) is None else pd.Timestamp(x).value // 1000


def _times(column: pd.Series) -> list[int | None]:
    at = pd.to_datetime(column)
    return [None if missing else v for v, missing in zip(at.to_numpy("datetime64[us]").astype("int64").tolist(), at.isna().tolist(), strict=True)]


def _whole(x) -> int | None:
    return None if _value(x) is None else int(x)


def _judged(book: Book, rows: pd.DataFrame) -> list[tuple[str, int]]:
    columns = [_times(rows["received_at"]), rows["kind"], [_value(v) for v in rows["decision_id"]], *(_times(rows[c]) for c in ("decided_at", "exit_at", "expires_at")), [_whole(v) for v in rows["risk"]]]
    return [book.take(*row) for row in zip(*columns, strict=True)]


def _verdicts(rows: pd.DataFrame, judged: list[tuple[str, int]]) -> pd.DataFrame:
    return rows[["book", "seq", "kind", "decision_id"]].assign(verdict=[v for v, _ in judged], open_risk=pd.Series([r for _, r in judged], index=rows.index, dtype="int64"))


def admissions(events: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A verdict for each event. A book is one task's work, its memory the open and closed decisions."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, book = object(), Book(budget)
        for rows in batches:
            judged: list[tuple[str, int]] = []
            for start, part in rows.groupby((rows["book"] != rows["book"].shift()).cumsum(), sort=False):
                if part["book"].iloc[0] != name:
                    name, book = part["book"].iloc[0], Book(budget)
                judged += _judged(book, part)
            yield _verdicts(rows, judged)

    ordered = events.select(*_NAMES).withColumn("book", F.coalesce("book", F.lit(""))).repartition("book").sortWithinPartitions("book", *_ORDER)
    return ordered.mapInPandas(fold, VERDICTS)


class Admission(StatefulProcessor):
    """The same fold over a stream; the state store holds one row per open and per closed decision."""

    budget = BUDGET

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "registered long, last long")
        self.opened = handle.getMapState("open", "decision_id string", "decided long, leave long, risk long")
        self.closed = handle.getMapState("closed", "decision_id string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        registered, last = self.meta.get() if self.meta.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values(list(_ORDER), kind="stable", na_position="first").reset_index(drop=True)
        book = Book(self.budget, registered, {k[0]: tuple(v) for k, v in self.opened.iterator()})
        ids = {d for d in batch["decision_id"] if isinstance(d, str)}
        book.closed = {d for d in ids if self.closed.containsKey((d,))}
        stale = batch["received_at"].map(_micros) < (last if last is not None else -(2**62))
        judged, held, gone = [], dict(book.open), set(book.closed)
        for late, (_, row) in zip(stale, batch.iterrows()):
            judged.append(("STALE", sum(t[2] for t in book.open.values())) if late else _judged(book, row.to_frame().T)[0])
        for d in held.keys() - book.open.keys():
            self.opened.removeKey((d,))
        for d in book.open.keys() - held.keys():
            self.opened.updateValue((d,), book.open[d])
        newest = max([last or -(2**62), *(_micros(v) for v in batch["received_at"])])
        for d in book.closed - gone:
            self.closed.updateValue((d,), (newest,))
        self.meta.update((book.registered, newest))
        yield _verdicts(batch, judged)

    def close(self) -> None:
        pass


def streaming_admissions(events: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Verdicts of a stream of ``events``; needs the RocksDB state store."""
    processor = type("Admission", (Admission,), {"budget": budget})()
    keyed = events.select(*_NAMES).withColumn("book", F.coalesce("book", F.lit("")))
    return keyed.groupBy("book").transformWithStateInPandas(processor, VERDICTS, "Append", "None")


def due(events: DataFrame, verdicts: DataFrame, now) -> DataFrame:
    """Open decisions with their planned exit, and whether that has come by ``now``."""
    named = lambda v, name: verdicts.filter(F.col("verdict") == v).select("book", F.col("decision_id")) if name is None else verdicts.filter(F.col("verdict") == v).select("book", "seq")
    admitted = events.withColumn("book", F.coalesce("book", F.lit(""))).join(named("ADMITTED", "seq"), ["book", "seq"])
    still = admitted.join(named("CLOSED_NOW", None), ["book", "decision_id"], "left_anti")
    return still.select("book", "decision_id", "exit_at", "risk", (F.col("exit_at") <= F.lit(now).cast("timestamp_ntz")).alias("due"))
