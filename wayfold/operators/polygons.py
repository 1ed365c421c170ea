"""Areas of any shape: several rings, holes and islands, by the parity of crossings.

An area is a list of rings, each a list of vertices without the first repeated; a
place is inside if it lies within an odd number of them.  Functions of one row need
no shuffle.  The outline of a union is an arrangement of edges: all edges are split
where they meet, by a grid join, and those stay that are covered on one side only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators import room
from wayfold.operators.line_joins import _listed
from wayfold.operators.polyline import at_distance, hypot, length, nearest_on_line, nearest_on_segment, ring_edges, segments
from wayfold.operators.spatial import _cell, finite, spread
from wayfold.workspace import Workspace

#: Decimal digits of the coordinates of an outline; what is nearer is one place.
DIGITS = 6
TOLERANCE = 2e-6
#: Medial width: metres left out at both ends, least length of the part and least number of samples.
TRIM, LEAST_LENGTH, LEAST_SAMPLES = 2.0, 14.0, 8
#: What a length may fall short of a whole number of metres by rounding.
SLACK = 1e-9


# ---------------------------------------------------------------- one row
def area_edges(rings: Column) -> Column:
    """Edges of all rings with at least two vertices."""
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 2), ring_edges))


def _inside(x: Column, y: Column, edges: Column) -> Column:
    crossed = F.filter(
        edges,
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def _edge_distance(x: Column, y: Column, edges: Column) -> Column:
    return F.array_min(F.transform(edges, lambda e: nearest_on_segment(x, y, e)["d"]))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in an area, by the parity of the edges to its right."""
    return _inside(x, y, area_edges(rings))


def edge_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance to the nearest edge of any ring."""
    return _edge_distance(x, y, area_edges(rings))


def contains(x: Column, y: Column, rings: Column) -> Column:
    """Inside, and on no edge."""
    return inside(x, y, rings) & (edge_distance(x, y, rings) > 0)


def covers(x: Column, y: Column, rings: Column) -> Column:
    """Inside or on an edge."""
    return inside(x, y, rings) | (edge_distance(x, y, rings) == 0)


def _inside_shares(s: Column, edges: Column) -> Column:
    """The stretches (from, to) of a segment, as shares of it, that lie in the area.

    The crossings of the segment's whole line are sorted; it is inside between the
    first and the second, the third and the fourth, and so on.
    """
    ax, ay, dx, dy = s["a"]["x"], s["a"]["y"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]

    def side(p: Column) -> Column:
        return dx * (p["y"] - ay) - dy * (p["x"] - ax)

    crossed = F.filter(edges, lambda e: (side(e["a"]) > 0) != (side(e["b"]) > 0))

    def share(e: Column) -> Column:
        at = side(e["a"]) / (side(e["a"]) - side(e["b"]))
        px, py = e["a"]["x"] + at * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + at * (e["b"]["y"] - e["a"]["y"])
        return ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)

    def pairs(at: Column) -> Column:
        def pair(i: Column) -> Column:
            return F.struct(F.greatest(F.lit(0.0), F.get(at, 2 * i)).alias("from"), F.get(at, 2 * i + 1).alias("end"))

        both = F.transform(F.sequence(F.lit(0), F.floor(F.size(at) / 2).cast("int")), pair)
        kept = F.filter(both, lambda p: p["from"] < F.least(F.lit(1.0), p["end"]))
        whole = F.filter(kept, lambda p: p["end"].isNotNull())
        return F.transform(whole, lambda p: F.struct(p["from"].alias("from"), F.least(F.lit(1.0), p["end"]).alias("to")))

    # bound to a name by a list of one, so that the crossings are sorted once
    return F.flatten(F.transform(F.array(F.array_sort(F.transform(crossed, share))), pairs))


_STRETCHES = "array<struct<from: double, to: double>>"


def inside_stretches(line: Column, rings: Column) -> Column:
    """The stretches (from, to) of a line, in distance along it, that lie in an area; touching ones are one.

    A line along an edge counts as lying on one side of it.
    """
    return _inside_stretches(line, area_edges(rings))


def _inside_stretches(line: Column, edges: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("done"), F.array().cast(_STRETCHES).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        n = hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        own = F.transform(
            F.when(n > 0, _inside_shares(s, edges)).otherwise(F.array().cast(_STRETCHES)),
            lambda p: F.struct((acc["done"] + p["from"] * n).alias("from"), (acc["done"] + p["to"] * n).alias("to")),
        )
        return F.struct((acc["done"] + n).alias("done"), F.concat(acc["found"], own).alias("found"))

    every = F.aggregate(segments(line), start, step, lambda acc: acc["found"])
    none = F.array().cast(_STRETCHES)

    def join(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), p["to"].alias("to"))))
        return F.when(F.size(acc) == 0, F.array(p)).when(p["from"] - last["to"] <= 1e-9, joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(every, none, join)


def stretch_of(line: Column, stretch: Column) -> Column:
    """The vertices of a line from one distance along it to another."""
    start = F.struct(F.lit(0.0).alias("done"), F.array().cast("array<struct<x: double, y: double>>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        done = acc["done"] + hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        own = F.when((done > stretch["from"]) & (done < stretch["to"]), F.array(s["b"])).otherwise(F.slice(F.array(s["b"]), 1, 0))
        return F.struct(done.alias("done"), F.concat(acc["found"], own).alias("found"))

    inner = F.aggregate(segments(line), start, step, lambda acc: acc["found"])
    return F.concat(F.array(at_distance(line, stretch["from"])), inner, F.array(at_distance(line, stretch["to"])))


def nearest_stretch(line: Column, rings: Column, x: Column, y: Column) -> Column:
    """The stretch inside the area that is nearest to a point: (d, from, to); the first of equal ones, null without any."""
    return _nearest_stretch(line, area_edges(rings), x, y)


def _nearest_stretch(line: Column, edges: Column, x: Column, y: Column) -> Column:
    def away(path: Column) -> Column:
        return nearest_on_line(x, y, path)["d"]

    parts = F.transform(
        _inside_stretches(line, edges),
        # bound to a name by a list of one, so that a stretch is cut out once, not for each of its vertices
        lambda p: F.struct(F.transform(F.array(stretch_of(line, p)), away)[0].alias("d"), p["from"].alias("from"), p["to"].alias("to")),
    )
    return F.array_min(parts)


def medial_width(df: DataFrame, line: str, rings: str, x: str, y: str, obstacles: str | None = None) -> DataFrame:
    """``df`` with the room along the stretch of the line that lies in the area nearest to the piece at (x, y).

    Samples stand every metre from ``TRIM`` metres after the stretch's beginning to
    as far before its end, where the area covers them; the room is twice the distance
    to the nearest edge, ``deducted`` twice the lesser of that and the distance to the
    nearest obstacle.  Adds status, n_samples, and least, p10 (by index), the upper
    median of both, and of obstacle less edge, 2 digits.  The first of these that
    holds is the status, without numbers: no area, not inside, too short, too few
    samples; else ok.

    Rows are measured together in arrays; those with a null or a coordinate that is
    not finite, of which there are few, by the same steps in Spark's functions.
    """
    path, edges, found = F.col(line), F.col("_edges"), F.col("_found")
    out = df.withColumn("_found", _rooms(line, rings, x, y, obstacles))
    area = F.when(found["status"].isNull(), F.col(rings))
    out = out.withColumn("_edges", area_edges(area))  # once a row, not once a sample
    out = out.withColumn("_part", F.when(F.size(edges) > 0, _nearest_stretch(path, edges, F.col(x), F.col(y))))
    out = out.withColumn("_own", F.when(F.col("_part").isNotNull(), stretch_of(path, F.col("_part")))).withColumn("_long", length(F.col("_own")) + SLACK)
    n = F.floor(F.col("_long") - 2 * TRIM).cast("int")
    places = F.transform(F.sequence(F.lit(0), n), lambda i: at_distance(F.col("_own"), i + F.lit(TRIM)))
    out = out.withColumn("_p", F.when(n >= 0, places))
    out = out.withColumn("_e", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _edge_distance(p["x"], p["y"], edges).alias("edge"))))
    out = out.withColumn("_at", F.filter("_e", lambda p: (p["edge"] == 0) | _inside(p["x"], p["y"], edges)))
    none = F.lit(None).cast("double")

    def measured(p: Column) -> Column:
        near = F.array_min(F.transform(F.col(obstacles), lambda o: nearest_on_line(p["x"], p["y"], o)["d"])) if obstacles else none
        return F.struct((2 * p["edge"]).alias("w"), (2 * F.least(p["edge"], near)).alias("v"), (near - p["edge"]).alias("g"))

    out = out.withColumn("_m", F.transform("_at", measured))
    status = (
        F.when(F.coalesce(F.size(area), F.lit(0)) <= 0, "no area")
        .when(F.col("_part").isNull(), "not inside")
        .when(F.col("_long") < LEAST_LENGTH, "too short")
        .when(F.size("_at") < LEAST_SAMPLES, "too few samples")
        .otherwise("ok")
    )
    out = out.withColumn("status", F.coalesce(found["status"], status))
    out = out.withColumn("n_samples", F.coalesce(found["n"], F.when(F.col("status") == "ok", F.size("_at"))))
    for name, field in (("width", "w"), ("deducted", "v"), ("gap", "g")):
        if field != "w" and not obstacles:
            continue
        out = out.withColumn("_s", F.when(F.col("status") == "ok", F.array_sort(F.col("_m")[field])))
        size = F.size("_s")
        p10 = F.greatest(F.lit(1), F.floor(size / 10).cast("int"))  # one less than the tenth, counted from 0
        for k, (label, at) in enumerate((("least", F.lit(1)), ("p10", p10), ("median", F.floor(size / 2).cast("int") + 1))):
            value = F.coalesce(found[f"{field}{k}"], F.when(size > 0, F.element_at("_s", at)))
            out = out.withColumn(f"{name}_{label}", F.floor(value * 100 + 0.5) / 100)
    return out.drop("_found", "_edges", "_part", "_own", "_long", "_p", "_e", "_at", "_m", "_s")


def _rooms(line: str, rings: str, x: str, y: str, obstacles: str | None) -> Column:
    """The numbers of rows whose lists and coordinates are all known and finite; see :func:`room.measured`."""
    fields = ", ".join(f"{f}{k}: double" for f in room.FIELDS for k in range(3))

    @F.arrow_udf(f"struct<status: string, n: int, {fields}>")
    def rooms(line: pa.Array, rings: pa.Array, x: pa.Array, y: pa.Array, *walls: pa.Array) -> pa.Array:
        return room.measured(line, rings, x, y, walls[0] if walls else None, TRIM, LEAST_LENGTH, LEAST_SAMPLES, SLACK)

    return rooms(*(F.col(c) for c in (line, rings, x, y, obstacles) if c))


# ---------------------------------------------------------------- joins
def assign_to_areas(pts: DataFrame, areas: DataFrame, x: str, y: str, rings: str, cell: float) -> DataFrame:
    """Points joined to the areas that hold them; points in none, or without finite coordinates, keep null columns.

    Areas are listed in the grid cells that their bounds touch.
    """
    xs, ys = F.flatten(rings)["x"], F.flatten(rings)["y"]
    tiles = areas.withColumn("_cx", F.explode(F.sequence(_cell(F.array_min(xs), cell), _cell(F.array_max(xs), cell))))
    tiles = tiles.withColumn("_cy", F.explode(F.sequence(_cell(F.array_min(ys), cell), _cell(F.array_max(ys), cell))))
    placed = pts.withColumn("_px", F.when(finite(x, y), _cell(F.col(x), cell))).withColumn("_py", F.when(finite(x, y), _cell(F.col(y), cell)))
    held = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & inside(placed[x], placed[y], tiles[rings])
    return placed.join(tiles, held, "left").drop("_px", "_py", "_cx", "_cy", rings)


# ---------------------------------------------------------------- outline of a union
def _edges(areas: DataFrame, key: str, id: str, rings: str) -> DataFrame:
    """(key, id, lowx, lowy, ax, ay, bx, by): edges from the lesser to the greater end, coordinates rounded, none of no length, and where their area begins.

    Areas of the same rings count once.
    """
    areas = areas.groupBy(key, rings).agg(F.min(id).alias(id))
    low = [F.round(F.array_min(F.flatten(rings)[k]), DIGITS).alias(f"low{k}") for k in "xy"]
    each = spread(areas, id).select(key, id, *low, F.explode(area_edges(F.col(rings))).alias("s"))
    ends = {f"{p}{k}": F.round(F.col(f"s.{p}.{k}"), DIGITS) for p in "ab" for k in "xy"}
    flat = each.select(key, id, "lowx", "lowy", *(c.alias(n) for n, c in ends.items())).filter("ax <> bx OR ay <> by")
    low = "ax < bx OR ax = bx AND ay < by"
    swapped = [F.expr(f"CASE WHEN {low} THEN {p}{k} ELSE {q}{k} END").alias(f"{p}{k}") for p, q in ("ab", "ba") for k in "xy"]
    return flat.select(key, id, "lowx", "lowy", *swapped)


def _meetings(edges: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, e, x, y): places where an edge meets another one, at a crossing or at an end of either."""
    lines = edges.select(key, "e", F.array(*(F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab")).alias("line"))
    one, two = _listed(lines, "e", "line", [key], cell, TOLERANCE, "s"), _listed(lines, "e", "line", [key], cell, TOLERANCE, "t")
    pairs = one.join(two.withColumnRenamed("e", "f").hint("merge"), [key, "_cx", "_cy"]).filter("e < f")
    runs = pairs.selectExpr("*", "sbx - sax AS sx", "sby - say AS sy", "tbx - tax AS tx", "tby - tay AS ty")
    solved = runs.selectExpr("*", "sx * ty - sy * tx AS den").selectExpr(
        "*", "((tax - sax) * ty - (tay - say) * tx) / nullif(den, 0D) AS u", "((tax - sax) * sy - (tay - say) * sx) / nullif(den, 0D) AS v"
    )
    places = F.array(F.expr(f"CASE WHEN u > 0 AND u < 1 AND v > 0 AND v < 1 THEN struct(round(sax + u * sx, {DIGITS}) AS x, round(say + u * sy, {DIGITS}) AS y) END"))
    both = F.transform(F.array_compact(places), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def on(p: str, s: str) -> str:
        """An end of one edge, if it lies on the other one."""
        at = f"(({p}x - {s}ax) * {s}x + ({p}y - {s}ay) * {s}y) / ({s}x * {s}x + {s}y * {s}y)"
        off = f"abs(({p}x - {s}ax) * {s}y - ({p}y - {s}ay) * {s}x) / sqrt({s}x * {s}x + {s}y * {s}y)"
        return f"CASE WHEN {off} <= {TOLERANCE!r}D AND {at} > 0 AND {at} < 1 THEN struct({p}x AS x, {p}y AS y) END"

    of_s = F.concat(both, F.array_compact(F.array(F.expr(on("ta", "s")), F.expr(on("tb", "s")))))
    of_t = F.concat(both, F.array_compact(F.array(F.expr(on("sa", "t")), F.expr(on("sb", "t")))))
    rows = solved.select(key, F.explode(F.array(F.struct("e", of_s.alias("p")), F.struct(F.col("f").alias("e"), of_t.alias("p")))).alias("m"))
    return rows.select(key, "m.e", F.explode("m.p").alias("p")).select(key, "e", "p.x", "p.y").distinct()


def _pieces(edges: DataFrame, meetings: DataFrame, key: str) -> DataFrame:
    """(key, ax, ay, bx, by): the distinct stretches between the places where edges meet."""
    at = meetings.groupBy(key, "e").agg(F.collect_set(F.struct("x", "y")).alias("at"))
    none = F.array().cast("array<struct<x: double, y: double>>")
    # from the lesser to the greater end, places along an edge are in the order of x and then y, or of x and then y falling
    rows = edges.join(at, [key, "e"], "left").withColumn("falls", F.col("by") < F.col("ay"))
    ends = F.array(*(F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"))
    places = F.array_union(ends, F.coalesce("at", none))
    order = F.transform(places, lambda p: F.struct(p["x"].alias("x"), F.when(F.col("falls"), -p["y"]).otherwise(p["y"]).alias("o"), p["y"].alias("y")))
    rows = rows.withColumn("p", F.array_sort(order))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.struct(*(F.col("p")[i - 1 if q == "a" else i][k].alias(f"{q}{k}") for q in "ab" for k in "xy")),
    )
    return rows.select(key, F.explode(pairs).alias("s")).select(key, "s.*").distinct()


def union_outline(areas: DataFrame, key: str, id: str, rings: str, cell: float) -> DataFrame:
    """(key, ax, ay, bx, by, inside_left): the edges around the union of all areas of a key.

    ``id`` is unique.  Edges lead from the lesser to the greater end (by x, then y);
    ``inside_left`` tells on which side the union lies.  Areas may overlap, touch, share
    whole edges or parts of them, and have holes.  ``cell`` is the width of the grid in
    which edges meet.  Null areas and empty rings count for nothing.
    """
    work = Workspace(areas.sparkSession, "union-outline")
    edges = work.table(_edges(areas, key, id, rings), "edges")
    # edges at the same place meet the same ones
    ends = ["ax", "ay", "bx", "by"]
    places = work.table(edges.select(key, *ends).distinct().withColumn("e", F.struct(*ends)), "places")
    pieces = work.table(_pieces(places, _meetings(places, key, cell), key), "pieces")
    # what lies above the middle of a flat piece, or to the right of a steep one, in strips across the ray
    flat = "bx - ax >= abs(by - ay)"
    mid = pieces.selectExpr("*", f"{flat} AS flat", "(ax + bx) / 2 AS mx", "(ay + by) / 2 AS my")
    mid = mid.withColumn("strip", F.floor(F.when(F.col("flat"), F.col("mx")).otherwise(F.col("my")) / cell).cast("long"))
    mid = mid.withColumn("row", F.floor(F.when(F.col("flat"), F.col("my")).otherwise(F.col("mx")) / cell).cast("long"))
    ex = edges.selectExpr(key, f"`{id}` AS _id", "lowx", "lowy", "ax AS px", "ay AS py", "bx AS qx", "by AS qy")
    # a place is within an area only above the area's beginning, so an edge is listed from there to itself
    sides = F.array(
        F.struct(F.lit(True).alias("flat"), F.least("px", "qx").alias("lo"), F.greatest("px", "qx").alias("hi"), F.col("lowy").alias("low"), F.greatest("py", "qy").alias("high")),
        F.struct(F.lit(False).alias("flat"), F.least("py", "qy").alias("lo"), F.greatest("py", "qy").alias("hi"), F.col("lowx").alias("low"), F.greatest("px", "qx").alias("high")),
    )
    listed = ex.withColumn("_o", F.explode(sides)).selectExpr("*", "_o.flat", "_o.lo", "_o.hi", "_o.low", "_o.high").drop("_o", "lowx", "lowy").filter("lo < hi")
    listed = listed.withColumn("strip", F.explode(F.sequence(F.floor(F.col("lo") / cell).cast("long"), F.floor(F.col("hi") / cell).cast("long"))))
    listed = listed.withColumn("row", F.explode(F.sequence(F.floor((F.col("low") - TOLERANCE) / cell).cast("long"), F.floor((F.col("high") + TOLERANCE) / cell).cast("long"))))
    spans = "(flat AND lo <= mx AND mx < hi OR NOT flat AND lo <= my AND my < hi)"
    away = "CASE WHEN flat THEN py + (mx - px) / (qx - px) * (qy - py) - my ELSE px + (my - py) / (qy - py) * (qx - px) - mx END"
    met = mid.join(listed.hint("merge"), [key, "flat", "strip", "row"]).filter(spans).withColumn("away", F.expr(away))
    # an edge at the piece itself lies between its two sides
    per = met.groupBy(key, "flat", "ax", "ay", "bx", "by", "_id").agg(
        F.sum(F.expr(f"CAST(away > {TOLERANCE!r}D AS INT)")).alias("beyond"), F.sum(F.expr(f"CAST(abs(away) <= {TOLERANCE!r}D AS INT)")).alias("own")
    )
    one = per.groupBy(key, "flat", "ax", "ay", "bx", "by").agg(
        F.bool_or(F.col("beyond") % 2 == 1).alias("far"), F.bool_or((F.col("beyond") + F.col("own")) % 2 == 1).alias("near")
    )
    # beyond a flat piece is its left; beyond a steep one its left only if it falls
    left = F.when(F.col("flat") | (F.col("by") < F.col("ay")), F.col("far")).otherwise(F.col("near"))
    return one.filter("far <> near").select(key, "ax", "ay", "bx", "by", left.alias("inside_left"))


def outline_measures(outline: DataFrame, key: str) -> DataFrame:
    """(key, n_edges, perimeter, area) of the unions, from their outlines."""
    double = F.expr("ax * by - bx * ay") * F.when(F.col("inside_left"), 1).otherwise(-1)
    long = F.expr("sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))")
    return outline.groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(long).alias("perimeter"), (F.sum(double) / 2).alias("area"))
