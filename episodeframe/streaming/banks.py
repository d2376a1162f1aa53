"""Banks of restart states as streams: keyed states that updates add to, and that entries leave by age, capacity or decision.

The rules are those of operators/banks.py, applied after each update; a key's updates are taken in order, and rows of an
update that has been applied are passed over as replays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stages import keyed_state

#: Keys that a tier without a cap is dealt to; fixed for the life of a checkpoint.
SLOTS = 256


class Bank(StatefulProcessor):
    """Entries by id in a map state, and the last update in a value state; apply() says what an update does to them."""

    names: list[str]
    value: str
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "update long")
        self.entries = handle.getMapState("entries", "id long", self.value)

    def apply(self, update: int, entries: dict[int, tuple], new: dict[int, tuple]) -> Iterator[tuple]:
        """Change entries in place; the rows that come out."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        updates: dict[int, dict[int, tuple]] = defaultdict(dict)
        for pdf in rows:
            for update, name, *value in pdf[["update", "id", *self.names]].itertuples(index=False):
                if update > last:
                    updates[int(update)][int(name)] = tuple(x.item() if hasattr(x, "item") else x for x in value)
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        entries, out = dict(before), []
        for update in sorted(updates):
            out += [(key[0], update, *row) for row in self.apply(update, entries, updates[update])]
            self.last.update((update,))
        for name in before.keys() - entries.keys():
            self.entries.removeKey((name,))
        for name, value in entries.items():
            if before.get(name) != value:
                self.entries.updateValue((name,), value)
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class Aged(Bank):
    """Entries (lookback) leave max_age updates after they came in, and beyond `cap`: one of each lookback in turn stays, newest first."""

    names, value = ["lookback"], "lookback long, admitted long"
    out = ["tier", "update", "id", "lookback", "admitted", "place"]

    def __init__(self, max_age: int, cap: int):
        self.max_age, self.cap = max_age, cap

    def apply(self, update, entries, new):
        entries.update({name: (lookback, update) for name, (lookback,) in new.items()})
        by: dict[int, list] = defaultdict(list)
        for name, (lookback, admitted) in entries.items():
            if admitted >= update - self.max_age:
                by[lookback].append((-admitted, -name))
        turns = sorted((turn, lookback, -name) for lookback, own in by.items() for turn, (_, name) in enumerate(sorted(own)))[: self.cap]
        kept = {name: entries[name] for _, _, name in turns}
        entries.clear()
        entries.update(kept)
        return [(name, lookback, admitted, place) for place, (name, (lookback, admitted)) in enumerate(kept.items(), 1)]


class Alive(StatefulProcessor):
    """Aged without a cap: no entry depends on another, so a key is a slot of a tier's entries, and hears of all the tier's updates. One value holds a slot."""

    def __init__(self, max_age: int):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "last long, entries array<struct<id: bigint, lookback: bigint, admitted: bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, entries = self.slot.get() if self.slot.exists() else (-1, [])
        entries = {name: (lookback, admitted) for name, lookback, admitted in entries}
        updates: dict[int, dict[int, int]] = defaultdict(dict)
        for pdf in rows:
            for update, entry, name, lookback in zip(*(pdf[c].tolist() for c in ("update", "entry", "id", "lookback")), strict=True):
                if update > last:
                    own = updates[update]
                    if entry:
                        own[name] = lookback
        out = []
        for update in sorted(updates):
            entries |= {name: (lookback, update) for name, lookback in updates[update].items()}
            entries = {name: value for name, value in entries.items() if value[1] >= update - self.max_age}
            out += [(key[0], update, name, *value) for name, value in entries.items()]
            last = update
        self.slot.update((last, [(name, *value) for name, value in entries.items()]))
        yield pd.DataFrame(out, columns=["tier", "update", "id", "lookback", "admitted"])

    def close(self) -> None:
        pass


class Evicting(Bank):
    """Entries (bucket, seed, usage, last_probe) are added or replaced; those beyond their bucket's capacity go, then those beyond their seed's."""

    names, value = ["bucket", "seed", "usage", "last_probe"], "bucket string, seed long, usage long, last_probe long"
    out = ["bank", "update", "id", "reason"]

    def __init__(self, per_bucket: int, per_seed: int):
        self.limits = ((0, per_bucket, "bucket"), (1, per_seed, "seed"))

    def apply(self, update, entries, new):
        entries.update(new)
        gone = []
        for column, limit, reason in self.limits:
            by: dict = defaultdict(list)
            for name, value in entries.items():
                by[value[column]].append((value[2], -value[3], -name))  # the least used stay, of these the last probed, of these the latest
            for own in by.values():
                gone += [(-name, reason) for *_, name in sorted(own)[limit:]]
            for name, _ in gone:
                entries.pop(name, None)
        return sorted(gone)


class Probed(StatefulProcessor):
    """Counts of a state's probe outcomes, until a budget of first and, if these were mixed, more probes decides."""

    def __init__(self, first: int, more: int, low: int, high: int):
        self.first, self.more, self.low, self.high = first, more, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "probes long, wins long, decided boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, wins, decided = self.counts.get() if self.counts.exists() else (0, 0, False)
        outcomes = sorted((int(i), bool(w)) for pdf in rows for i, w in pdf[["n", "won"]].itertuples(index=False))
        out = []
        for i, won in outcomes:
            if decided or i < n:
                continue
            if i > n:
                raise ValueError(f"state {key[0]}: probe {i} follows {n - 1}")
            n, wins = n + 1, wins + won
            if (n == self.first and wins in (0, n)) or n == self.first + self.more:
                decided = True
                out.append((key[0], n, wins, n > self.first and self.low <= wins <= self.high))
        self.counts.update((n, wins, decided))
        yield pd.DataFrame(out, columns=["state_id", "probes", "wins", "accepted"])

    def close(self) -> None:
        pass


def refreshed_stream(new: DataFrame, max_age: int = 20, cap: int | None = 64) -> DataFrame:
    """(tier, update, id, lookback, admitted, place): each tier's bank after every update of a stream of entries (tier, update, id, lookback) that touches it.

    A tier with a cap is one key, whose state the cap bounds. Without one (None) there is no place in turn, and a tier of any size is dealt to SLOTS keys.
    """
    keyed_state(new.sparkSession)
    if cap is not None:
        return new.groupBy("tier").transformWithStateInPandas(Aged(max_age, cap), "tier long, update long, id long, lookback long, admitted long, place long", "Append", "None")
    zero = F.lit(0).cast("long")
    own = new.select("tier", F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("_slot"), "update", F.lit(True).alias("entry"), "id", "lookback")
    told = new.select("tier", "update").dropDuplicates().select("tier", F.explode(F.sequence(zero, F.lit(SLOTS - 1).cast("long"))).alias("_slot"), "update", F.lit(False).alias("entry"), zero.alias("id"), zero.alias("lookback"))
    return own.unionByName(told).groupBy("tier", "_slot").transformWithStateInPandas(Alive(max_age), "tier long, update long, id long, lookback long, admitted long", "Append", "None")


def evicted_stream(new: DataFrame, per_bucket: int = 4, per_seed: int = 16) -> DataFrame:
    """(bank, update, id, reason) of what leaves a bank with each update of a stream of entries (bank, update, id, bucket, seed, usage, last_probe)."""
    keyed_state(new.sparkSession)
    return new.groupBy("bank").transformWithStateInPandas(Evicting(per_bucket, per_seed), "bank long, update long, id long, reason string", "Append", "None")


def accepted_stream(probes: DataFrame, first: int = 8, more: int = 16, low: int = 3, high: int = 21) -> DataFrame:
    """(state_id, probes, wins, accepted) of the states of a stream of outcomes (state_id, n from 0, won), each when its budget decides; a gap in n is an error."""
    keyed_state(probes.sparkSession)
    return probes.groupBy("state_id").transformWithStateInPandas(Probed(first, more, low, high), "state_id long, probes long, wins long, accepted boolean", "Append", "None")
