"""Rotations: a few slots, filled by rank, emptied by age, by a signal or by a stop."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Rotation:
    """top slots; a name leaves after `hold` days, on its exit signal, `stop` below its cost, or `trail` below the highest
    close since it came, and may come back after `pause` days. `every`: decisions are made every so many days. On a day
    whose mask is off nothing is bought, and with `off_sells` all is sold. Fills at the day's open or its close."""

    name: str
    top: int
    hold: int
    at_open: bool = True
    masked: bool = False
    stop: float | None = None
    trail: float | None = None
    pause: int = 0
    every: int = 1
    off_sells: bool = False


SLIP, STALE, LOT, CASH = 0.001, 20, 100, 1e6


class Book:
    """One rotation's cash and holdings; nothing else is kept between days."""

    def __init__(self, rule: Rotation) -> None:
        self.rule, self.cash, self.held, self.left = rule, CASH, {}, {}

    def worth(self) -> float:
        return self.cash + sum(p["n"] * p["last"] for p in self.held.values())

    def _sell(self, code, t: int, price: float, done: list) -> None:
        p = self.held.pop(code)
        net = price * (1 - SLIP)
        self.cash += p["n"] * net
        self.left[code] = t
        done.append(net / p["cost"] - 1)

    def day(self, t: int, on: bool, rows: dict, ranked: list) -> tuple[float, list]:
        """rows: code -> (open, close, exit, at its lower limit); ranked: the codes that may be bought, best first."""
        r, done = self.rule, []
        due = t % r.every == 0
        fill = lambda code: rows[code][0] if r.at_open and rows[code][0] > 0 else rows[code][1]
        prior = {}
        for code, p in self.held.items():
            prior[code] = (p["last"], p["peak"])
            if code in rows:
                p["last"], p["miss"] = rows[code][1], 0
                p["peak"] = max(p["peak"], p["last"])
        for code in sorted(self.held):
            p = self.held[code]
            if code not in rows:
                p["miss"] += 1
                if p["miss"] >= STALE:
                    self._sell(code, t, p["last"], done)
                continue
            last, peak = prior[code]  # a stop is seen at the close before
            hit = (r.stop is not None and last <= p["cost"] * (1 - r.stop)) or (r.trail is not None and last <= peak * (1 - r.trail))
            out = hit or (due and (t - p["since"] >= r.hold or rows[code][2])) or (r.masked and r.off_sells and not on)
            if out and not rows[code][3]:
                self._sell(code, t, fill(code), done)
        if due and (on or not r.masked):
            for code in ranked:
                if len(self.held) >= r.top:
                    break
                if code in self.held or (r.pause and t - self.left.get(code, t - r.pause) < r.pause):
                    continue
                cost = (rows[code][0] if r.at_open else rows[code][1]) * (1 + SLIP)
                if not cost > 0:
                    continue
                n = int(self.worth() / r.top / cost / LOT) * LOT
                if n > 0 and n * cost <= self.cash:
                    self.cash -= n * cost
                    self.held[code] = {"n": n, "cost": cost, "since": t, "last": rows[code][1], "peak": rows[code][1], "miss": 0}
        if r.pause and len(self.left) > 50 * r.top:
            self.left = {c: s for c, s in self.left.items() if t - s < r.pause}
        elif not r.pause:
            self.left.clear()
        return self.worth(), done


OUT = "name string, date date, v double, trades int, wins int, gain double, loss double"


def candidates(scored: DataFrame, tried: int) -> DataFrame:
    """scored (kind, code, date, open, close, score, exit, lim_up, lim_dn, on) as rows for `rotate`: the score and exit of
    the row before decide; rank is among the codes that trade on the day and aren't at their upper limit.

    Only codes that were among the first `tried` on some day are kept, and each from its first such day on: no other can
    be held. So what reaches a task grows with days and slots, not with the number of codes.
    """
    w = W.partitionBy("kind", "code").orderBy("date")
    x = scored.withColumns({"_s": F.lag("score").over(w), "exit": F.coalesce(F.lag("exit").over(w), F.lit(False))})
    may = F.col("_s").isNotNull() & ~F.col("lim_up") & (F.col("close") > 0)
    x = x.withColumn("rank", F.when(may, F.row_number().over(W.partitionBy("kind", "date", may).orderBy(F.desc("_s"), "code"))))
    x = x.withColumn("rank", F.when(F.col("rank") <= tried, F.col("rank")))
    first = F.min(F.when(F.col("rank").isNotNull(), F.col("date"))).over(W.partitionBy("kind", "code"))
    return x.withColumn("_f", first).where(F.col("date") >= F.col("_f")).select("kind", "date", "code", "open", "close", "rank", "exit", "lim_dn", "on")


def rotate(rows: DataFrame, rules: dict[str, list[Rotation]]) -> DataFrame:
    """name, date, v (worth over the cash at first), and the day's closed trades, for every rule of each kind.

    rows: of `candidates`. A kind's rows reach one task in order of date and are streamed through its rules; the task holds
    a day and the holdings. An empty table gives no rows.
    """
    names = ["name", "date", "v", "trades", "wins", "gain", "loss"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = books = None
        t, out, held = 0, [], None

        def close_day(kind, date, g):
            nonlocal now, books, t
            if kind != now:
                now, t, books = kind, 0, [Book(r) for r in rules[kind]]
            day = {c: (o, p, e, dn) for c, o, p, e, dn in zip(g["code"], g["open"], g["close"], g["exit"], g["lim_dn"])}
            ranked = g[g["rank"].notna()].sort_values("rank")["code"].tolist()
            on = bool(g["on"].iloc[0])
            for b in books:
                v, done = b.day(t, on, day, ranked)
                out.append((b.rule.name, date, v / CASH, len(done), sum(x > 0 for x in done), sum(x for x in done if x > 0), -sum(x for x in done if x <= 0)))
            t += 1

        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            edge = ((batch["kind"] != batch["kind"].shift()) | (batch["date"] != batch["date"].shift())).to_numpy().nonzero()[0]
            for a, z in zip(edge[:-1], edge[1:]):
                close_day(batch["kind"][a], batch["date"][a], batch.iloc[a:z])
            held = batch.iloc[edge[-1] :].reset_index(drop=True) if len(edge) else None
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held is not None and len(held):
            close_day(held["kind"][0], held["date"][0], held)
        yield pd.DataFrame(out, columns=names)

    return rows.repartition(len(rules), "kind").sortWithinPartitions("kind", "date", "code").mapInPandas(run, OUT)
