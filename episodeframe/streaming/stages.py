"""The adaptive stage machine of restart training: a pilot that must show learning, then frontiers chosen anew from probes.

What an update says whatever the state is (facts()) is found by Spark; one step function folds that for a table (a run's updates in order) and
for a stream (updates in any order: the next one is folded, later ones wait in the state, earlier ones are replays).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.statistics import wilson_bounds


@dataclass(frozen=True)
class Plan:
    """Budgets in updates and the rule of selection; phase `pilot` ends with the gate."""

    pilot_updates: int = 10
    adaptive_updates: int = 40
    probe_every: int = 5
    samples: int = 24
    low: float = 0.3
    high: float = 0.7
    phase: str = "staged"


#: A probe's summary; kind: `start` (true starts), `frontier` (candidates) or `pilot` (independent probes of the pilot's state).
SUMMARY = "struct<kind: string, state_id: string, env_step: bigint, samples: bigint, successes: bigint, mean_reward: double, mean_pellets: double, variance: double>"
UPDATE = f"run long, version long, adv_count long, adv_variance double, summaries array<{SUMMARY}>"
OUT = "run long, version long, stage string, event string, current string, env_step long"
NAMES = ["run", "version", "stage", "event", "current", "env_step"]
#: Stages that no update leaves.
OVER = ("stopped", "passed", "completed")


@dataclass
class Machine:
    """What a run carries from update to update: typed, as it is kept in the state of a stream. The last four are the pilot's first probe."""

    last: int = -1
    stage: str = "new"
    current: str = ""
    env_step: int = 0
    signal: bool = False
    samples: int = 0
    successes: int = 0
    reward: float = 0.0
    pellets: float = 0.0
    variance: float = 0.0

    def step(self, plan: Plan, version: int, count: int, variance: float, summaries: list[dict]) -> tuple | None:
        """advance() by an update as it was recorded: what facts() says of it, in plain loops."""
        keys = [(s["kind"], s["state_id"]) for s in summaries]
        twice = next((k for k in keys if keys.count(k) > 1), None)
        starts = [_rate(s) for s in summaries if s["kind"] == "start"]
        fit = [
            (s["env_step"], s["state_id"]) for s in summaries
            if s["kind"] == "frontier" and s["samples"] >= plan.samples and plan.low <= _rate(s) <= plan.high and (s["env_step"] > 0 or version)
        ]
        told = {
            "signal": count > 1 and variance > 1e-12,
            "cold": any(r >= plan.low for r in starts),
            "above": bool(starts) and all(r > plan.high for r in starts),
            "pilots": [s for s in summaries if s["kind"] == "pilot"],
            "wrong": twice and f"two {twice[0]} summaries of {twice[1]}",
        }
        told["env_step"], told["state_id"] = min(fit) if fit else (0, None)
        return self.advance(plan, version, *(told[c] for c in FACT_NAMES))

    def advance(self, plan: Plan, version: int, signal: bool, cold: bool, above: bool, env_step: int, state_id: str | None, pilots: list[dict] | None, wrong: str | None) -> tuple | None:
        """Fold the next update, told by its facts(); (stage, event, current, env_step), or nothing once the run is over. Version 0 is the probe before training."""
        if version != self.last + 1:
            raise ValueError(f"version {version} follows {self.last}")
        self.last = version
        if self.stage in OVER:
            return None
        if wrong:
            raise ValueError(f"version {version} has {wrong}")
        self.signal |= signal
        event = self._event(plan, version, cold, above, (env_step, state_id), pilots)
        return self.stage, event, self.current, self.env_step

    def _event(self, plan: Plan, version: int, cold: bool, above: bool, fit: tuple, pilots: list[dict] | None) -> str:
        if version == 0:
            if cold:
                return self._over("stopped", "initial_cold_start_assumption_not_supported")
            if not self._choose(fit):
                return self._over("stopped", "no_initial_learnable_restart_state")
            before = self._pilot(pilots)
            self.samples, self.successes, self.reward, self.pellets, self.variance = (before[c] for c in ("samples", "successes", "mean_reward", "mean_pellets", "variance"))
            self.stage = "pilot"
            return "pilot_selected"
        if version < plan.pilot_updates:
            return "train"
        if version == plan.pilot_updates:
            if not self._learned(self._pilot(pilots)):
                return self._over("stopped", "pilot_inconclusive")
            if plan.phase == "pilot":
                return self._over("passed", "pilot_passed")
            self.stage = "staged"
        if version >= plan.pilot_updates + plan.adaptive_updates:
            return self._over("completed", "bounded_run_completed")
        if (version - plan.pilot_updates) % plan.probe_every:
            return "train"
        if self._choose(fit):
            return "adaptive_selected"
        return self._over("stopped", "true_start_above_frontier" if above else "no_current_learnable_frontier")

    def _over(self, stage: str, event: str) -> str:
        self.stage = stage
        return event

    def _choose(self, fit: tuple) -> bool:
        if fit[1] is not None:
            self.env_step, self.current = fit
        return fit[1] is not None

    def _pilot(self, pilots: list[dict]) -> dict:
        return {s["state_id"]: s for s in _plain(pilots)}[self.current]

    def _learned(self, after: dict) -> bool:
        """The gate: enough samples, success intervals apart, more reward or pellets, a training signal, and rewards that differed before."""
        enough = min(self.samples, after["samples"]) >= 24
        apart = wilson_bounds(after["successes"], after["samples"])[0] > wilson_bounds(self.successes, self.samples)[1]
        more = after["mean_reward"] > self.reward or after["mean_pellets"] > self.pellets
        return enough and apart and more and self.signal and self.variance > 0


def _rate(summary: dict) -> float:
    return summary["successes"] / summary["samples"] if summary["samples"] else 0.0


def _plain(summaries) -> list[dict]:
    return [s if isinstance(s, dict) else s.asDict() for s in summaries]


PILOT = "struct<state_id: string, samples: bigint, successes: bigint, mean_reward: double, mean_pellets: double, variance: double>"
FACTS = f"signal boolean, cold boolean, above boolean, env_step bigint, state_id string, pilots array<{PILOT}>, wrong string"
FACT_NAMES = ["signal", "cold", "above", "env_step", "state_id", "pilots", "wrong"]


def facts(updates: DataFrame, plan: Plan) -> DataFrame:
    """(run, version, FACTS): what the machine asks of an update (UPDATE), whatever state it is in.

    `signal`: advantages that differ; `cold`, `above`: a true start at least at the range's low end, all of them beyond its high end; env_step,
    state_id: the earliest candidate with enough samples and a rate in range, the least id on a tie, at version 0 none at step 0; `pilots`: their
    probes, at the two versions that ask for them; `wrong`: why the update can't be folded.
    """
    start, kind = F.col("version") == 0, lambda name: lambda s: s["kind"] == name
    rate = lambda s: F.when(s["samples"] != 0, s["successes"] / s["samples"]).otherwise(0.0)
    starts = F.transform(F.filter("summaries", kind("start")), rate)
    fit = F.filter("summaries", lambda s: (s["kind"] == "frontier") & (s["samples"] >= plan.samples) & rate(s).between(plan.low, plan.high) & (~start | (s["env_step"] > 0)))
    best = F.array_min(F.transform(fit, lambda s: F.struct(s["env_step"].alias("env_step"), s["state_id"].alias("state_id"))))
    counted = lambda s: rate(s).isNotNull() & ((s["kind"] != "frontier") | (s["samples"].isNotNull() & s["env_step"].isNotNull()))
    whole = F.col("adv_count").isNotNull() & F.col("adv_variance").isNotNull() & F.forall("summaries", lambda s: s["kind"].isNotNull() & s["state_id"].isNotNull() & counted(s))
    texts = F.transform("summaries", lambda s: F.concat(s["kind"], F.lit(" "), s["state_id"]))  # only where these meet are pairs compared
    same = lambda s: F.size(F.filter("summaries", lambda x: (x["kind"] == s["kind"]) & (x["state_id"] == s["state_id"]))) > 1
    twice = F.when(F.size(F.array_distinct(texts)) < F.size("summaries"), F.get(F.filter("summaries", same), F.lit(0)))
    pilots = F.transform(F.filter("summaries", kind("pilot")), lambda s: F.struct(*(s[c].alias(c) for c in ("state_id", "samples", "successes", "mean_reward", "mean_pellets", "variance"))))
    found = updates.select(
        "run", "version",
        F.coalesce((F.col("adv_count") > 1) & (F.col("adv_variance") > 1e-12) & ~F.isnan("adv_variance"), F.lit(False)).alias("signal"),
        starts.alias("_starts"), best.alias("_best"), F.when(F.col("version").isin(0, plan.pilot_updates), pilots).alias("pilots"),
        F.coalesce(whole, F.lit(False)).alias("_whole"), twice.alias("_twice"),
    )
    return found.select(
        "run", "version", "signal",
        F.coalesce(F.array_max("_starts") >= plan.low, F.lit(False)).alias("cold"),
        F.coalesce(F.array_min("_starts") > plan.high, F.lit(False)).alias("above"),
        F.coalesce("_best.env_step", F.lit(0).cast("long")).alias("env_step"), "_best.state_id", "pilots",
        F.when(~F.col("_whole"), "a value missing").otherwise(F.concat(F.lit("two "), "_twice.kind", F.lit(" summaries of "), "_twice.state_id")).alias("wrong"),
    )


def fold(updates: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row (OUT) for each update of a table (UPDATE) up to the one that ends its run. Runs come one after another, each with its updates
    from 0 on in order, so many are folded in one batch and a run of any length is carried from batch to batch."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, machine = None, None
        for batch in batches:
            out = []
            for own, version, *told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or own != run:
                    run, machine = own, Machine()
                if (found := machine.advance(plan, version, *told)) is not None:
                    out.append((run, version, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(NAMES), ARROW, strict=True)], NAMES)

    return facts(updates, plan).repartition("run").sortWithinPartitions("run", "version").mapInArrow(runs, OUT)


ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
STATE = "last long, stage string, current string, env_step long, signal boolean, samples long, successes long, reward double, pellets double, variance double"
#: Runs of consecutive numbers that share a stream's key: their states are read and written together.
TOGETHER = 64


class Stages(StatefulProcessor):
    """fold() over a stream: a value holds the typed machines of a key's runs, each with the updates that came early."""

    def __init__(self, plan: Plan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", f"runs array<struct<run: bigint, machine: struct<{STATE}>, early: array<struct<version: bigint, {FACTS}>>>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = {run: (Machine(*machine), {version: told for version, *told in early}) for run, machine, early in (self.runs.get()[0] if self.runs.exists() else ())}
        for pdf in rows:
            for run, version, *told in zip(*(pdf[c].tolist() for c in ("run", "version", *FACT_NAMES)), strict=True):
                machine, early = runs.setdefault(int(run) if run == run else None, (Machine(), {}))  # a null comes as not a number
                if version > machine.last:
                    early[int(version)] = told
        out = []
        for run, (machine, early) in runs.items():
            while (told := early.pop(machine.last + 1, None)) is not None:
                if (found := machine.advance(self.plan, machine.last + 1, *told)) is not None:
                    out.append((run, machine.last, *found))
        self.runs.update(([(run, tuple(getattr(m, f.name) for f in fields(Machine)), [(v, *told[:5], _probes(told[5]), told[6]) for v, told in early.items()]) for run, (m, early) in runs.items()],))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def _probes(pilots) -> list[tuple] | None:
    return None if pilots is None else [tuple(s[c] for c in ("state_id", "samples", "successes", "mean_reward", "mean_pellets", "variance")) for s in _plain(pilots)]


def keyed_state(spark) -> None:
    """Streams with keyed states need the RocksDB store; it is set unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_stream(updates: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """fold() over a stream of updates (UPDATE), in whatever order they come."""
    keyed_state(updates.sparkSession)
    return facts(updates, plan).withColumn("_runs", F.expr(f"run div {TOGETHER}")).groupBy("_runs").transformWithStateInPandas(Stages(plan), OUT, "Append", "None")
