"""Promotion by a window of batches: the same fold over a table and over a stream.

Updates may arrive out of order (a file source orders by modification time), so an update is
folded only when it is the next one; earlier ones are replays and later ones wait in the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """A window of `window` batches is judged once it is full and holds enough games and maps of the current tier.

    stretch=True widens the window where batches hold fewer games than planned, until it holds what `window` full batches would.
    """

    window: int = 3
    least_games: int = 24
    threshold: float = 0.5
    consecutive: int = 2
    least_maps: int = 1
    max_tier: int = 6
    stretch: bool = False
    #: Games of another tier than the current one are an error instead of being passed over.
    strict: bool = False


@dataclass
class State:
    tier: int = 0
    last: int = -1
    streak: int = 0
    recent: list = field(default_factory=list)

    def step(self, policy: Policy, update: int, tiers: list[tuple]) -> tuple:
        """Fold the next update, rows (tier, games, wins, planned, maps); only those of the current tier count.

        (games, maps, ready, passed, tier before, tier after). A promotion starts window and streak anew.
        """
        if policy.strict and (others := sorted(int(t[0]) for t in tiers if t[0] != self.tier)):
            raise ValueError(f"update {update} has games of tiers {others}, the current one is {self.tier}")
        own = next((t for t in tiers if t[0] == self.tier), (self.tier, 0, 0, 0, ()))
        recent = [*self.recent, [int(own[1]), int(own[2]), sorted(int(m) for m in own[4])]]
        size, least = policy.window, policy.least_games
        if policy.stretch:
            least = max(least, policy.window * int(own[3]))
            while len(recent) > policy.window and sum(b[0] for b in recent[1:]) >= least:
                recent = recent[1:]
            size = max(policy.window, len(recent))
        self.recent, self.last = recent[-size:], update
        games, wins = (sum(b[k] for b in self.recent) for k in (0, 1))
        maps = len({m for b in self.recent for m in b[2]})
        ready = len(self.recent) == size and games >= least and maps >= policy.least_maps
        passed = ready and wins / games >= policy.threshold
        self.streak = self.streak + 1 if passed else 0
        before = self.tier
        if self.streak >= policy.consecutive and before < policy.max_tier:
            self.tier, self.streak, self.recent = before + 1, 0, []
        return games, maps, ready, passed, before, self.tier

    def handed_over(self, tier: int = 0) -> State:
        """The state a new stage starts with: statistics are reset, the update counter goes on."""
        return State(tier=tier, last=self.last)


NAMES = ["run", "update", "games", "maps", "ready", "passed", "tier_before", "tier_after"]
OUT = "run long, update long, games long, maps long, ready boolean, passed boolean, tier_before long, tier_after long"
TIER = "array<struct<tier: bigint, games: bigint, wins: bigint, planned: bigint, maps: array<bigint>>>"


def batches(episodes: DataFrame, counted=None) -> DataFrame:
    """(run, update, tiers) from episodes (run, update, group_id, tier, won, map): each update's games, wins and maps by tier.

    `counted` says which groups count (all rows of a group alike); `planned` counts the games of all groups.
    """
    counted = F.lit(True) if counted is None else counted
    per = episodes.groupBy("run", "update", "tier").agg(
        F.count_if(counted).alias("games"), F.count_if(counted & F.col("won")).alias("wins"), F.count(F.lit(1)).alias("planned"), F.collect_set(F.when(counted, F.col("map"))).alias("maps")
    )
    one = F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("tier", "games", "wins", "planned")), F.sort_array("maps").cast("array<bigint>").alias("maps"))
    return per.groupBy("run", "update").agg(F.array_sort(F.collect_list(one)).alias("tiers"))


def fault_free(episodes: DataFrame) -> DataFrame:
    """episodes with `counted`: the group has no fault and a normal start. A fault takes its whole group out, a restart is no evidence."""
    groups = episodes.groupBy("group_id").agg((~F.bool_or("fault") & F.bool_and("normal")).alias("counted"))
    return episodes.join(groups, "group_id")


def _tiers(value) -> list[tuple]:
    return [(t["tier"], t["games"], t["wins"], t["planned"], t["maps"]) for t in value]


def fold(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row an update (OUT) from batches (run, update, tiers); a run is one small group of updates from 0 on. A gap is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for r, u, tiers in pdf.sort_values("update")[["run", "update", "tiers"]].itertuples(index=False):
            if u != state.last + 1:
                raise ValueError(f"run {r}: update {u} follows {state.last}")
            out.append((r, u, *state.step(policy, u, _tiers(tiers))))
        return pd.DataFrame(out, columns=NAMES)

    return table.groupBy("run").applyInPandas(run, OUT)


def fold_stream(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """fold() over a stream: what comes early waits in the state until its turn, what was folded before is passed over."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        saved, early = held.get if held.exists else (json.dumps(asdict(State())), "{}")
        state, waiting, out = State(**json.loads(saved)), json.loads(early), []
        for pdf in pdfs:
            for u, tiers in pdf[["update", "tiers"]].itertuples(index=False):
                if u > state.last:
                    waiting[str(u)] = [[int(x) for x in t[:4]] + [[int(m) for m in t[4]]] for t in _tiers(tiers)]
        while str(state.last + 1) in waiting:
            u = state.last + 1
            out.append((key[0], u, *state.step(policy, u, waiting.pop(str(u)))))
        held.update((json.dumps(asdict(state)), json.dumps(waiting)))
        yield pd.DataFrame(out, columns=NAMES)

    return table.groupBy("run").applyInPandasWithState(run, OUT, "state string, early string", "append", GroupStateTimeout.NoTimeout)
