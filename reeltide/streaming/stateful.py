"""Pairing, merging and tracking with a state of bounded size, by transformWithStateInPandas.

Rows of a key arrive in the order of `seq`, in micro-batches cut anywhere; what comes out does not depend on the cuts. The state is one JSON text a key. A row whose kind is null closes a key: what waits is given out.
The session must use the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reeltide.operators import tracking

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """step(state, row) -> rows out, over the rows of a key in the order of `seq`; `state` is a dictionary that JSON can hold and step changes."""

    def __init__(self, step: Callable[[dict, tuple], list[tuple]], columns: list[str], out: list[str]):
        self.step, self.columns, self.out = step, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        for row in got[self.columns].astype(object).where(got[self.columns].notna(), None).itertuples(index=False, name=None):
            out += [(*key, *r) for r in self.step(state, row)]
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.out).astype(object)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, step, columns: list[str], out: str) -> DataFrame:
    form = f"{key} {rows.schema[key].dataType.simpleString()}, {out}"
    names = [key, *[x.split()[0] for x in out.split(", ")]]
    return rows.groupBy(key).transformWithStateInPandas(Machine(step, columns, names), form, "Append", "None")


def pair_step(bound: int):
    """Base rows (kind 0) leave in their order, each with the dependent row (kind 1) of its time; one is given up as soon as `bound` later ones have come, a dependent as soon as `bound` later dependents have."""

    def step(state: dict, row: tuple) -> list[tuple]:
        kind, t, ident = row
        bases, deps = state.setdefault("bases", []), state.setdefault("deps", [])  # [t, id, dependent or None, waits]
        if kind is None:
            for b in bases:
                b[3] = False
        elif kind == 0:
            found = next((d for d in deps if d[0] == t), None)
            bases.append([int(t), int(ident), found[1] if found else None, found is None])
            state["n"] = state.get("n", 0) + 1
            if len(bases) > bound:
                bases[len(bases) - bound - 1][3] = False
        else:
            if not any(d[0] == t for d in deps):
                for b in bases:
                    if b[0] == t and b[3]:
                        b[2], b[3] = int(ident), False
            deps.append([int(t), int(ident)])
            del deps[:-bound]
        out = []
        while bases and not bases[0][3]:
            b = bases.pop(0)
            out.append((b[1], b[2]))
        return out

    return step


def paired_bounded(rows: DataFrame, key: str, bound: int = 2048) -> DataFrame:
    """(key, seq, kind, t, id) -> (key, id, dependent): operators.pairing.paired_bounded on a stream. A state holds at most `bound` rows a side, and a base row that waits holds back those after it."""
    return _run(rows, key, pair_step(bound), ["kind", "t", "id"], "id bigint, dependent bigint")


def merge_step(sources: int):
    """A row leaves when every source that is not closed has one waiting, the earliest time first, then the lowest source."""

    def step(state: dict, row: tuple) -> list[tuple]:
        kind, t, ident = row
        waiting, closed = state.setdefault("waiting", [[] for _ in range(sources)]), state.setdefault("closed", [])
        if t is None:
            closed.extend([int(kind)] if kind is not None else range(sources))
        else:
            waiting[int(kind)].append([int(t), int(ident)])
        out = []
        while any(waiting) and all(w or i in closed for i, w in enumerate(waiting)):
            first = min((i for i in range(sources) if waiting[i]), key=lambda i: (waiting[i][0][0], i))
            state["n"] = state.get("n", 0) + 1
            out.append((waiting[first].pop(0)[1], first, state["n"]))
        return out

    return step


def merged(rows: DataFrame, key: str, sources: int = 2) -> DataFrame:
    """(key, seq, kind, t, id) -> (key, id, source, place) with the places of operators.pairing.merged, if every source comes in the order of its times. A row with a kind and no t closes that source, one without either all."""
    return _run(rows, key, merge_step(sources), ["kind", "t", "id"], "id bigint, source int, place bigint")


def track_step(rules: tracking.Rules):
    """operators.tracking on a stream: a picture is judged when the next one begins, or at a closing row."""

    def step(state: dict, row: tuple) -> list[tuple]:
        picture, *box, prob = row
        lines = tracking.Lines(rules, [[x[0], tuple(x[1]), *x[2:]] for x in state.get("lines", [])], state.get("count", 0))
        out = []
        if "picture" in state and picture != state["picture"]:
            out = [(state["picture"], *told) for told in lines.picture([(tuple(b), p) for b, p in state["regions"]])]
            state["lines"], state["count"], state["regions"] = lines.lines, lines.count, []
        if picture is None:
            state.pop("picture", None)
        else:
            state["picture"] = int(picture)
            state.setdefault("regions", [])
            if box[0] is not None:
                state["regions"].append([[float(x) for x in box], float(prob)])
        return out

    return step


def tracked(rows: DataFrame, key: str, rules: tracking.Rules) -> DataFrame:
    """(key, seq, picture, x0, y0, x1, y1, p) -> (key, picture, line, prob, lift, found), as operators.tracking.tracked gives them."""
    return _run(rows, key, track_step(rules), ["picture", "x0", "y0", "x1", "y1", "p"], "picture bigint, line bigint, prob double, lift double, found boolean")
