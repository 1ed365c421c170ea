"""Time slots on links: demand, capacity, conflicts and their resolution.

Who gets a slot depends on who came before, so resolution is sequential within
a scenario; scenarios are independent and run in parallel.  Inputs of such
scenarios are made up, not measured.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of ten minutes, the order of kinds, how late a general request may become.
SLOTS, KINDS, GENERAL_DELAY = 6, ("evac", "emergency", "general"), 2


def kind_order(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in reversed(list(enumerate(KINDS))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def demand(requests: DataFrame, lanes: DataFrame) -> DataFrame:
    """Cells (link_id, slot) with the requests that want them; overload if they are more than the lanes.

    ``requests``: id, slot, hold, route (array of links).  ``lanes``: link_id, lanes.
    """
    cells = requests.select("id", F.explode("route").alias("link_id"), "slot", "hold").select(
        "id", "link_id", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("hold") - 1)).alias("slot")
    )
    wanted = cells.groupBy("link_id", "slot").agg(F.countDistinct("id").alias("demand"))
    return wanted.join(lanes, "link_id").withColumn("overload", F.col("demand") > F.col("lanes"))


def capacity(cells: DataFrame, closed: DataFrame) -> DataFrame:
    """Lanes of each cell, none where it is closed or evacuated."""
    shut = closed.select("link_id", "slot", F.lit(True).alias("_shut")).distinct()
    out = cells.join(shut, ["link_id", "slot"], "left")
    return out.withColumn("capacity", F.when(F.col("_shut"), 0).otherwise(F.col("lanes"))).drop("_shut")


def cell_state(demand: Column, evacuating: Column, lanes: Column) -> tuple[Column, Column]:
    """Whether a cell is overloaded before evacuation takes it, and after."""
    return demand > lanes, (demand - evacuating) > F.when(evacuating > 0, 0).otherwise(lanes)


def evacuation_slots(rate: Column) -> Column:
    """Twice the rate, halves to even, from 1 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.bround((2 * rate).cast("decimal(18, 6)"), 0).cast("int")))


def decisions(requests: Iterable[dict], lanes: dict[int, int], slots: int = SLOTS, used: dict | None = None) -> Iterator[dict]:
    """Decisions on the requests of one scenario, which come in order of kind and id.

    A request: id, kind, slot, hold, route and alternative (lists of links or
    None).  Evacuation is confirmed always and takes its links from all others.
    An emergency that does not fit takes its alternative, else the first later
    slot.  A general request may be late by two slots; else it gets advice,
    which is never carried out.  What is held in between are cells, not requests.
    """
    used = dict(used or {})
    shut: set[tuple[int, int]] = set()

    def cells(route: list[int], slot: int, hold: int) -> list[tuple[int, int]]:
        return [(link, s) for link in route for s in range(slot, slot + hold)]

    def fits(route: list[int] | None, slot: int, hold: int) -> bool:
        if not route or slot + hold > slots:
            return False
        return all(c not in shut and used.get(c, 0) < lanes.get(c[0], 0) for c in cells(route, slot, hold))

    for r in requests:
        route, slot, hold = r["route"], r["slot"], r["hold"]
        status, delay = "unresolved", 0
        if route:
            if r["kind"] == "evac":
                status = "confirmed"
                shut.update(cells(route, slot, hold))
            elif fits(route, slot, hold):
                status = "confirmed"
            elif r["kind"] == "emergency":
                if fits(r.get("alternative"), slot, hold):
                    status, route = "rerouted", r["alternative"]
                else:
                    later = next((s for s in range(slot + 1, slots) if fits(route, s, hold)), None)
                    if later is not None:
                        status, delay = "delayed", later - slot
            else:
                later = next((s for s in range(slot + 1, slot + GENERAL_DELAY + 1) if fits(route, s, hold)), None)
                status, delay = ("delayed", later - slot) if later is not None else ("advice", 0)
        done = status in ("confirmed", "rerouted", "delayed")
        if done and r["kind"] != "evac":
            for c in cells(route, slot + delay, hold):
                used[c] = used.get(c, 0) + 1
        yield {"id": r["id"], "kind": r["kind"], "status": status, "slot": slot + delay, "delay": delay, "route": list(route or []), "done": done}


def resolve_one(requests: list[dict], lanes: dict[int, int], slots: int = SLOTS, used: dict | None = None) -> list[dict]:
    """:func:`decisions` on requests in any order."""
    rank = {k: i for i, k in enumerate(KINDS)}
    return list(decisions(sorted(requests, key=lambda r: (rank.get(r["kind"], len(KINDS)), r["id"])), lanes, slots, used))


RESOLVED = "scenario long, id long, kind string, status string, slot int, delay int, route array<long>, done boolean"
_ARROW = pa.schema(
    [("scenario", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("status", pa.string()), ("slot", pa.int32()), ("delay", pa.int32()), ("route", pa.list_(pa.int64())), ("done", pa.bool_())]
)
#: Decisions that are given out together.
AT_ONCE = 4096


def resolve(requests: DataFrame, lanes: DataFrame) -> DataFrame:
    """Decisions of all scenarios, each in one task, whose rows pass in order and are not gathered.

    ``requests``: scenario, id, kind, slot, hold, route, alternative.  ``lanes``:
    scenario, link_id, lanes; a scenario without lanes is left out.
    """
    links = F.expr("CAST(NULL AS ARRAY<BIGINT>)")
    own = requests.select(
        F.col("scenario").cast("long").alias("scenario"),
        kind_order(F.col("kind")).alias("place"),
        F.col("id").cast("long").alias("id"),
        "kind",
        *(F.col(c).cast("int").alias(c) for c in ("slot", "hold")),
        *(F.col(c).cast("array<bigint>").alias(c) for c in ("route", "alternative")),
    )
    # a scenario's lanes come before its requests
    first = lanes.select(F.col("scenario").cast("long").alias("scenario"), F.lit(-1).alias("place"), F.col("link_id").cast("long").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("lanes").cast("int").alias("slot"), F.lit(0).alias("hold"), links.alias("route"), links.alias("alternative"))
    rows = own.unionByName(first).filter("scenario IS NOT NULL").repartition("scenario").sortWithinPartitions("scenario", "place", "id")
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = (r for batch in batches for at in range(0, batch.num_rows, AT_ONCE) for r in batch.slice(at, AT_ONCE).to_pylist())
        out: list[dict] = []
        for scenario, group in groupby(passing, key=lambda r: r["scenario"]):
            table: dict[int, int] = {}
            for r in group:
                if r["place"] >= 0:
                    break
                table[r["id"]] = r["slot"]
            else:
                continue
            if not table:
                continue
            for d in decisions(chain([r], group), table):
                out.append({"scenario": scenario, **d})
                if len(out) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows.mapInArrow(work, RESOLVED)


def ledger(resolved: DataFrame) -> DataFrame:
    """Delays and open requests by kind, and over all."""
    return (
        resolved.rollup("kind")
        .agg(
            F.grouping("kind").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            (F.sum("delay") * 10).alias("minutes"),
            (F.max("delay") * 10).alias("most"),
            F.count(F.when(~F.col("done"), 1)).alias("n_open"),
        )
        .withColumn("kind", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("kind")))
        .drop("_all")
    )


def affected(resolved: DataFrame, scope: DataFrame, after: int) -> DataFrame:
    """Decisions that an incident touches: done, not over by ``after``, on a link in scope; all others are locked."""
    hit = (
        resolved.filter(F.col("done") & (F.col("slot") + F.col("hold") > after))
        .select("scenario", "id", F.explode("route").alias("link_id"))
        .join(scope.select("link_id").distinct(), "link_id", "left_semi")
        .select("scenario", "id")
        .distinct()
    )
    return resolved.join(hit.withColumn("again", F.lit(True)), ["scenario", "id"], "left").withColumn("again", F.coalesce("again", F.lit(False)))


def first_free(cells: DataFrame, routes: DataFrame, hold: int, last: int, keep: str | None = None) -> DataFrame:
    """The first slot from which every link of a route is free for ``hold`` slots, by (actor); null if none is.

    ``cells``: link_id, slot, free.  ``routes``: actor, link_id.  With ``keep``, a
    column of a link that must be free from then to the last slot.
    """
    need = routes.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(last - hold + 1))))
    until = F.col("start") + hold - 1
    if keep:
        until = F.when(F.col("link_id") == F.col(keep), F.lit(last)).otherwise(until)
    wanted = need.withColumn("slot", F.explode(F.sequence(F.col("start"), until)))
    tested = wanted.join(cells.select("link_id", "slot", "free"), ["link_id", "slot"], "left")
    open_ = tested.groupBy("actor", "start").agg(F.bool_and(F.coalesce(F.col("free") > 0, F.lit(False))).alias("ok"))
    return open_.groupBy("actor").agg(F.min(F.when(F.col("ok"), F.col("start"))).alias("slot"))


def staging_candidates(links: DataFrame, reach: DataFrame, water: DataFrame) -> DataFrame:
    """Links where vehicles could wait, in order of (distance to water, hops, id).

    ``links``: link_id, lanes.  ``reach``: link_id, hop.  ``water``: link_id, d.
    """
    return links.join(reach, "link_id").join(water, "link_id", "left").filter("lanes >= 2").orderBy(F.asc_nulls_last("d"), "hop", "link_id")


def stage_vehicles(
    candidates: list[tuple[int, int]], free: dict[tuple[int, int], int], last: int, most: int = 3, keep: tuple[int, ...] = ()
) -> list[tuple[int, int]]:
    """(slot, link) of vehicles that wait from a slot to the last one.

    ``candidates`` are (link, lanes) in their order of preference; ``free`` the
    lanes left of each (link, slot).  Slot by slot the candidates are scanned from
    the start again after each placement; a place must be free to the end and
    leave a lane to pass.  Links in ``keep`` stay open.
    """
    left, out = dict(free), []
    for slot in range(last + 1):
        placed = True
        while placed and len(out) < most:
            placed = False
            for link, _ in candidates:
                cells = [(link, s) for s in range(slot, last + 1)]
                if link not in keep and all(left.get(c, 0) >= 2 for c in cells):
                    for c in cells:
                        left[c] -= 1
                    out.append((slot, link))
                    placed = True
                    break
    return out


def place_general(requests: list[dict], lanes: dict[int, int], observed: dict[tuple[int, int], int], used: dict[tuple[int, int], int]) -> list[dict]:
    """General requests in order of id, in their slot or up to two later, under observed capacity where there is one."""
    used, out = dict(used), []
    for r in sorted(requests, key=lambda r: r["id"]):
        status, delay = "unresolved", 0
        for d in range(GENERAL_DELAY + 1):
            cells = [(link, s) for link in r["route"] for s in range(r["slot"] + d, r["slot"] + d + r["hold"])]
            if cells and all(used.get(c, 0) < observed.get(c, lanes.get(c[0], 0)) for c in cells):
                for c in cells:
                    used[c] = used.get(c, 0) + 1
                status, delay = ("confirmed" if d == 0 else "delayed"), d
                break
        out.append({"id": r["id"], "status": status, "delay": delay})
    return out
