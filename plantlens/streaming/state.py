"""Stateful processing of samples in order of time, with typed state in Spark's state store."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def need_rocksdb(df: DataFrame) -> None:
    """transformWithState keeps its variables in RocksDB; a session with another provider would fail inside the query."""
    if "RocksDB" not in df.sparkSession.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def order_key(values: list) -> list:
    """A key that sorts nulls first and never compares them with values."""
    return [(v is not None, v) for v in values]


def thawed(value: object, kind: DataType) -> object:
    """Structs as dicts, at any depth, so that a step can change them, and instants with their zone, as input rows have them."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: thawed(v, f.dataType) for f, v in zip(kind, value, strict=True)}
    if isinstance(kind, ArrayType):
        return [thawed(v, kind.elementType) for v in value]
    if isinstance(kind, TimestampType) and value.tzinfo is None:
        return value.astimezone(datetime.timezone.utc)
    return value


def frozen(value: object, kind: DataType) -> object:
    """Dicts as tuples in the order of the state's fields."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(frozen((value.asDict() if isinstance(value, Row) else value).get(f.name), f.dataType) for f in kind)
    return [frozen(v, kind.elementType) for v in value] if isinstance(kind, ArrayType) else value


class InOrder(StatefulProcessor):
    """Applies step(held, row) -> list of output tuples to a stream's new samples, in order of time; `held` is the state as a dict.

    held["seq"] counts the samples since the beginning or the last reset; held["last"] is the order key of the last one, so that older
    samples are left out. `kinds` has the state's further fields.
    """

    def __init__(self, step: Callable[[dict, Row], list[tuple]], kinds: StructType, places: StructType, ts: str, ties: tuple[str, ...], reset: str | None, names: list[str]):
        self.step, self.ts, self.ties, self.reset, self.names = step, ts, ties, reset, names
        self.kinds = StructType().add("last", places).add("seq", "long")
        for f in kinds:
            self.kinds.add(f)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", self.kinds)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        given = initialState.asDict(recursive=True)
        self.state.update(frozen({f.name: given.get(f.name) for f in self.kinds}, self.kinds))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = thawed(self.state.get(), self.kinds) if self.state.exists() else {"last": None, "seq": 0}
        columns = [self.ts, *self.ties]
        for row in sorted(rows, key=lambda r: order_key([r[c] for c in columns])):
            at = [row[c] for c in columns]
            last = held["last"] and [held["last"][c] for c in columns]
            if last and (order_key(at) < order_key(last) or self.ties and at == last):
                continue  # late
            if self.reset and row[self.reset] is True:
                held = {"seq": 0}
            held["last"] = dict(zip(columns, at, strict=True))
            for made in self.step(held, row):
                yield Row(**dict(zip(self.names, (*key, *made), strict=True)))
            held["seq"] += 1
        self.state.update(frozen(held, self.kinds))

    def close(self) -> None:
        pass


class Reorder(StatefulProcessor):
    """Holds samples back and lets them out in order of time; see telemetry.ordered_stream."""

    def __init__(self, kinds: StructType, places: StructType, key: str, ts: str, ties: tuple[str, ...], wait: datetime.timedelta, mark: bool):
        self.kinds, self.key, self.ts, self.ties, self.wait, self.mark = kinds, key, ts, ties, wait, mark
        self.place = StructType().add("last", places).add("newest", "timestamp").add("seq", "long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kinds)
        self.out = handle.getValueState("out", self.place)

    def _at(self, row: Row) -> list:
        return order_key([row[c] for c in (self.ts, *self.ties)])

    def _known(self) -> dict:
        return thawed(self.out.get(), self.place) if self.out.exists() else {"last": None, "newest": None, "seq": 0}

    def _held(self) -> list[Row]:
        return [Row(**thawed(r, self.kinds)) for r in self.rows.get()]

    def _frozen(self, row: Row) -> tuple:
        return frozen(row.asDict(), self.kinds)

    def _keep(self, rows: list[Row]) -> None:
        if rows:
            self.rows.put([self._frozen(r) for r in rows])
        else:
            self.rows.clear()

    def _let_out(self, known: dict, free: list[Row]) -> Iterator[Row]:
        for row in free:
            yield Row(**row.asDict(), seq=known["seq"], late=False)
            known["seq"] += 1
            known["last"] = {c: row[c] for c in (self.ts, *self.ties)}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known, new = self._known(), []
        last = known["last"] and order_key([known["last"][c] for c in (self.ts, *self.ties)])
        for row in rows:
            if last and self._at(row) < last:
                if self.mark:
                    yield Row(**row.asDict(), seq=None, late=True)
            else:
                new.append(row)
        if not new:
            return
        newest = max([r[self.ts] for r in new] + [known["newest"]] * (known["newest"] is not None))
        if newest != known["newest"]:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + 1)
            known["newest"] = newest
        # What is held is read and written anew only where some of it goes out.
        held = self._held()
        free = sorted((r for r in held + new if r[self.ts] < newest - self.wait), key=self._at)
        if free:
            yield from self._let_out(known, free)
            self._keep([r for r in held + new if r[self.ts] >= newest - self.wait])
        else:
            self.rows.appendList([self._frozen(r) for r in new])
        self.out.update(frozen(known, self.place))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        known, held = self._known(), self._held()
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._let_out(known, sorted((r for r in held if r[self.ts].timestamp() * 1000 < now), key=self._at))
        self._keep([r for r in held if r[self.ts].timestamp() * 1000 >= now])
        self.out.update(frozen(known, self.place))

    def close(self) -> None:
        pass


def as_json(value: object) -> str:
    """A column's value as JSON text: rows as objects, what JSON lacks as text."""
    plain = value.asDict(recursive=True) if isinstance(value, Row) else value
    return json.dumps(plain, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))
