"""Union of polygons as a planar arrangement: split every edge where others meet it, keep what has one covered side.

Coordinates are snapped to a grid of ``PER_UNIT`` steps a unit, 0.1 mm for degrees. Edges are split
at crossings and at vertices that lie on them until none meets another but at its ends; snapping
bends split edges by less than a step, so the split is repeated until it finds nothing. Pairs
are looked for within squares of a quadtree, whose squares are split where edges are many. An
edge's side is covered if a member has its inside there; borders with both sides covered, and
those inside another member, are inner and vanish. What is left is chained into rings by
pointer jumping, in as many rounds as the longest ring has binary digits.

Members are valid polygons: no ring crosses itself, the first ring is the outer one, the others
are holes. Members may overlap, repeat, share borders in part, and touch in single points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.functions import geometry
from geomarket.operators.polygons import DEFAULT_SQUARE, grid_points, matched, points_in_polygons, region_bounds
from geomarket.session import written

PER_UNIT = 10**9
# Points this near to the outline are on it: the region is known to half a step.
_BORDER = -0.5 / PER_UNIT
# Edges in a square above which it is split, unless it is as small as `_SMALLEST` steps.
CROWDED = 64
_SMALLEST = 6
_TOP = 40
# Binary digits that a split square gains on each axis.
_STRIDE = 2
_ENDS = ["x1", "y1", "x2", "y2"]
_EDGE = ["region", *_ENDS]
_ROUNDS = 40


def _region(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def _area(ring: Column) -> Column:
    """Twice the signed area: positive for rings that run counterclockwise. Small coordinates keep it exact."""
    return F.aggregate(geometry.ring_edges(ring), F.lit(0.0), lambda a, e: a + (
        (e["x1"] - ring[0]["x"]) * (e["y2"] - ring[0]["y"]) - (e["x2"] - ring[0]["x"]) * (e["y1"] - ring[0]["y"])))


def _ascending() -> Column:
    return F.struct("x1", "y1") < F.struct("x2", "y2")


def _canonical(df: DataFrame) -> DataFrame:
    """Edges from their smaller end to the larger one; ``left`` tells where the inside is. Points are dropped."""
    forward = _ascending()
    return df.where("x1 <> x2 or y1 <> y2").withColumns({
        "x1": F.when(forward, F.col("x1")).otherwise(F.col("x2")), "y1": F.when(forward, F.col("y1")).otherwise(F.col("y2")),
        "x2": F.when(forward, F.col("x2")).otherwise(F.col("x1")), "y2": F.when(forward, F.col("y2")).otherwise(F.col("y1")),
        "left": F.when(forward, F.col("left")).otherwise(~F.col("left"))})


def _members(polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Different members of each region, numbered; a repeated member adds nothing."""
    return polygons.select(*by, "rings").withColumn("region", _region(by)).dropDuplicates(["region", "rings"]).withColumn(
        "member", F.xxhash64("region", "rings"))


def _uses(members: DataFrame) -> DataFrame:
    """Every member's edges on the grid, with the exact ends."""
    rings = members.select("region", "member", F.posexplode("rings").alias("ring", "points")).where(
        F.size("points") > 2).withColumn("inside_left", (_area(F.col("points")) > 0) == (F.col("ring") == 0))
    edges = rings.select("region", "member", F.col("inside_left").alias("left"),
                         F.explode(geometry.ring_edges(F.col("points"))).alias("e"))
    return edges.select("region", "member", "left", "e", *(
        F.round(F.col(f"e.{c}") * PER_UNIT).cast("long").alias(c) for c in _ENDS))


def _children(level: int) -> Column:
    """The squares of a level that an edge may pass, of those below its present square."""
    side, reach = 1 << (_TOP - level), 2.0

    def steps(axis: str) -> Column:
        low, high = F.least(f"{axis}1", f"{axis}2"), F.greatest(f"{axis}1", f"{axis}2")
        first, last = F.floor((low - reach) / side), F.floor((high + reach) / side)
        first = F.greatest(first, F.col(f"c{axis}") * (1 << _STRIDE))
        last = F.least(last, F.col(f"c{axis}") * (1 << _STRIDE) + ((1 << _STRIDE) - 1))
        # A sequence whose end lies before its beginning would run backwards.
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def passes(cx: Column, cy: Column) -> Column:
        # How far the square's middle is off the line, against the square's own reach across it.
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        off = F.abs(dx.cast("double") * ((cy + 0.5) * side - F.col("y1")) - dy.cast("double") * ((cx + 0.5) * side - F.col("x1")))
        return off <= (F.abs(dx) + F.abs(dy)) * (side / 2 + reach)

    return F.filter(F.flatten(F.transform(steps("x"), lambda cx: F.transform(
        steps("y"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))), lambda c: passes(c["cx"], c["cy"]))


def in_squares(edges: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges with every square of a quadtree that they pass: ``level``, ``cx``, ``cy``.

    A square is split while more than ``crowded`` edges pass it. Only counts decide, by
    squares, and only crowded squares are gone through again.
    """
    extent = edges.agg(*(F.max(F.greatest(F.abs(F.col(f"{a}1")), F.abs(F.col(f"{a}2")))) for a in "xy")).first()
    reach = max((v or 0 for v in extent), default=0) + 4
    # The first squares are as wide as the region is far from the origin; empty ones cost nothing.
    level = max(0, _TOP - max(1, int(reach).bit_length()))
    # All four squares around the origin, each once.
    start = edges.withColumns({
        "cx": F.explode(F.array(*(F.lit(v).cast("long") for v in (-1, 0))))}).withColumn(
        "cy", F.explode(F.array(*(F.lit(v).cast("long") for v in (-1, 0)))))
    open_, leaves = start, []
    while True:
        level += _STRIDE
        passed = written(open_.withColumn("c", F.explode(_children(level))).withColumns(
            {"cx": F.col("c.cx"), "cy": F.col("c.cy"), "level": F.lit(level)}).drop("c"), "squares")
        large = passed.groupBy("region", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > crowded).drop("n")
        if level + _STRIDE > _TOP - _SMALLEST or large.isEmpty():
            leaves.append(passed)
            break
        large = written(large, "crowded")
        leaves.append(passed.join(large, ["region", "cx", "cy"], "left_anti"))
        open_ = passed.join(large, ["region", "cx", "cy"], "left_semi")
    found = leaves[0]
    for leaf in leaves[1:]:
        found = found.unionByName(leaf)
    return found


def _cross(prefix: str, x: Column, y: Column) -> Column:
    """Twice the area of an edge and a point; positive on the left of the edge."""
    x1, y1, x2, y2 = (F.col(f"{prefix}.{c}").cast("double") for c in _ENDS)
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)


def _touches(prefix: str, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, within one step, between its ends and is neither of them."""
    x1, y1, x2, y2 = (F.col(f"{prefix}.{c}") for c in _ENDS)
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    length_sq = dx * dx + dy * dy
    along = dx * (x - x1) + dy * (y - y1)
    cross = _cross(prefix, x, y)
    return (~((x == x1) & (y == y1)) & ~((x == x2) & (y == y2)) & along.between(F.lit(0.0), length_sq)
            & (cross * cross <= length_sq))


def split_points(edges: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Points ``px``, ``py`` at which edges must be split; an edge that meets others at its ends only has none."""
    shapes = in_squares(edges, crowded).select("region", "level", "cx", "cy", F.struct(*_ENDS).alias("e"))
    others = shapes.withColumnRenamed("e", "f")

    def low(side: str, axis: str) -> Column:
        return F.least(f"{side}.{axis}1", f"{side}.{axis}2")

    def high(side: str, axis: str) -> Column:
        return F.greatest(f"{side}.{axis}1", f"{side}.{axis}2")

    # Each pair once, in a fixed order, so that both edges are split at the very same point.
    near = [low("e", a) - 1 <= high("f", a) for a in "xy"] + [low("f", a) - 1 <= high("e", a) for a in "xy"]
    pairs = shapes.join(others, ["region", "level", "cx", "cy"]).where(F.col("e") < F.col("f"))
    for condition in near:
        pairs = pairs.where(condition)

    def ends(of: str) -> list[tuple[Column, Column]]:
        return [(F.col(f"{of}.x{k}"), F.col(f"{of}.y{k}")) for k in (1, 2)]

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("long").alias("px"), y.cast("long").alias("py"))

    on_e = [(x, y, _touches("e", x, y)) for x, y in ends("f")]
    on_f = [(x, y, _touches("f", x, y)) for x, y in ends("e")]
    of_f = [_cross("e", x, y) for x, y in ends("f")]
    of_e = [_cross("f", x, y) for x, y in ends("e")]
    none = ~(on_e[0][2] | on_e[1][2] | on_f[0][2] | on_f[1][2])
    crossing = (F.signum(of_f[0]) * F.signum(of_f[1]) < 0) & (F.signum(of_e[0]) * F.signum(of_e[1]) < 0) & none
    part = F.try_divide(of_e[0], of_e[0] - of_e[1])
    at = point(*(F.round(F.col(f"e.{a}1") + part * (F.col(f"e.{a}2") - F.col(f"e.{a}1"))) for a in "xy"))

    def all_of(touched: list) -> Column:
        return F.filter(F.array(*(F.when(hit, point(x, y)) for x, y, hit in touched), F.when(crossing, at)),
                        lambda p: p.isNotNull())

    both = pairs.select("region", F.explode(F.array(
        F.struct(F.col("e").alias("s"), all_of(on_e).alias("points")),
        F.struct(F.col("f").alias("s"), all_of(on_f).alias("points")))).alias("one"))
    return both.select("region", *(F.col(f"one.s.{c}").alias(c) for c in _ENDS), F.explode("one.points").alias("p")).select(
        *_EDGE, "p.px", "p.py").distinct()


def split(uses: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The same borders in pieces that meet at their ends only."""
    uses = written(_canonical(uses), "edges")
    for _ in range(_ROUNDS):
        points = written(split_points(uses.select(_EDGE).distinct(), crowded), "split-points")
        if points.isEmpty():
            return uses
        own = points.select(_EDGE).distinct()
        along = F.expr("cast(x2 - x1 as double) * (px - x1) + cast(y2 - y1 as double) * (py - y1)")
        stops = points.unionByName(own.select("*", F.col("x1").alias("px"), F.col("y1").alias("py"))).unionByName(
            own.select("*", F.col("x2").alias("px"), F.col("y2").alias("py"))).withColumn("along", along)
        pieces = stops.selectExpr(*_EDGE, "px as from_x", "py as from_y", *(
            f"lead({c}) over (partition by {', '.join(_EDGE)} order by along, px, py) as to_{c[1]}" for c in ("px", "py")))
        parts = pieces.where("to_x is not null")
        whole = uses.join(own, _EDGE, "left_anti")
        divided = uses.join(parts, _EDGE).select(
            "region", "member", "left", F.col("from_x").alias("x1"), F.col("from_y").alias("y1"),
            F.col("to_x").alias("x2"), F.col("to_y").alias("y2"))
        uses = written(whole.unionByName(_canonical(divided)).distinct(), "pieces")
    raise RuntimeError(f"edges still cross after {_ROUNDS} rounds of splitting")


def outline(polygons: DataFrame, by: Sequence[str] = (), crowded: int = CROWDED, side: float = DEFAULT_SQUARE) -> DataFrame:
    """Edges of the union of each region's polygons, with its inside on their left: region and ``x1`` to ``y2``.

    Ends that lie on no other edge keep the coordinates they came with.
    """
    members = written(_members(polygons, by), "members")
    uses = written(_uses(members), "uses")
    pieces = split(uses.select("member", "left", *_EDGE), crowded)
    sides = pieces.groupBy(_EDGE).agg(
        F.max("left").alias("left"), F.max(~F.col("left")).alias("right"), F.collect_set("member").alias("members"))
    bare = written(sides.where(F.col("left") != F.col("right")), "bare")
    # No edge passes through a piece, so its middle tells whether another member covers it.
    middles = bare.select(*_EDGE, "members", *(
        ((F.col(f"{a}1") + F.col(f"{a}2")) / (2.0 * PER_UNIT)).alias(f"middle_{a}") for a in "xy"))
    covered = points_in_polygons(
        middles, members.select("member", "rings", F.col("region").alias("other_region")), x="middle_x", y="middle_y",
        keep=("member", "other_region"), side=side,
    ).where("region = other_region and not array_contains(members, member)").select(_EDGE).distinct()
    kept = bare.join(covered, _EDGE, "left_anti")
    directed = kept.select("region", *(
        F.when(F.col("left"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(_ENDS, ["x2", "y2", "x1", "y1"], strict=True)))
    # Each grid point's own coordinates: the smallest of those that were snapped to it.
    exact = uses.select("region", F.explode(F.array(*(F.struct(
        F.col(f"x{k}").alias("gx"), F.col(f"y{k}").alias("gy"), F.struct(
            F.col(f"e.x{k}").alias("x"), F.col(f"e.y{k}").alias("y")).alias("at")) for k in (1, 2)))).alias("v")).groupBy(
        "region", "v.gx", "v.gy").agg(F.min("v.at").alias("at"))
    found = directed
    for k in (1, 2):
        there = exact.select("region", F.col("gx").alias(f"x{k}"), F.col("gy").alias(f"y{k}"), F.col("at").alias(f"at{k}"))
        found = found.join(there, ["region", f"x{k}", f"y{k}"], "left")
    return found.select("region", *(
        F.coalesce(F.col(f"at{k}.{a}"), F.col(f"{a}{k}") / float(PER_UNIT)).alias(f"{a}{k}")
        for k in (1, 2) for a in "xy"))


def dissolve_outline(polygons: DataFrame, by: Sequence[str] = (), side: float = DEFAULT_SQUARE) -> DataFrame:
    """Outline edges of the union of polygons, per group: ``x1`` to ``y2``, the smaller end first."""
    forward = _ascending()
    edges = outline(polygons, by, side=side)
    names = polygons.select(*by, _region(by).alias("region")).dropDuplicates(["region"])
    return edges.join(names, "region").select(*by, *(
        F.when(forward, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(_ENDS, ["x2", "y2", "x1", "y1"], strict=True)))


def region_edges(polygons: DataFrame, side: float = DEFAULT_SQUARE) -> DataFrame:
    """The union of all polygons as one row with ``edges``; no row without polygons."""
    return written(outline(polygons, side=side).groupBy("region").agg(
        F.collect_list(F.struct(*_ENDS)).alias("edges")).select("edges"), "region")


def points_in_region(points: DataFrame, polygons: DataFrame, *, x: str = "lng", y: str = "lat",
                     side: float = DEFAULT_SQUARE) -> DataFrame:
    """Points that lie within the union of the polygons, each once; its outline does not count, inner borders do."""
    return matched(points, region_edges(polygons, side), x, y, (), side, _BORDER, "left_semi")


def uniform_points(polygons: DataFrame, number_x: int, number_y: int, *, side: float = DEFAULT_SQUARE) -> DataFrame:
    """Evenly spaced points of the extent of the polygons' union that fall within it."""
    region = region_edges(polygons, side)
    return matched(grid_points(region_bounds(region), number_x, number_y), region, "x", "y", (), side, _BORDER, "left_semi")


def _successors(edges: DataFrame, nearest: bool) -> DataFrame:
    """For each edge the one that goes on at its end, within ``chain``: the first clockwise from it, or the last."""
    back = F.atan2(F.col("e.y1") - F.col("e.y2"), F.col("e.x1") - F.col("e.x2"))
    out = F.atan2(F.col("f.y2") - F.col("f.y1"), F.col("f.x2") - F.col("f.x1"))
    turn = F.pmod(back - out, F.lit(2 * 3.141592653589793))
    # Straight back is the last choice, not the first.
    turn = F.when(turn == 0, 2 * 3.141592653589793).otherwise(turn)
    pairs = edges.alias("e").join(edges.alias("f"), (
        (F.col("e.chain") == F.col("f.chain")) & (F.col("e.x2") == F.col("f.x1")) & (F.col("e.y2") == F.col("f.y1"))))
    best = F.min_by if nearest else F.max_by
    return pairs.groupBy(F.col("e.id").alias("id")).agg(best(F.col("f.id"), F.struct(turn, F.col("f.id"))).alias("next"))


def _smallest(successors: DataFrame) -> DataFrame:
    """``id`` and ``ring``, the smallest id of the cycle that it lies on."""
    state = written(successors.select("id", "next", F.col("id").alias("ring")), "cycles")
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("ring").alias("theirs"))
        jumped = written(state.join(ahead, "next").select(
            "id", F.col("then").alias("next"), F.least("ring", "theirs").alias("ring"),
            (F.col("theirs") < F.col("ring")).alias("changed")), "cycles")
        if jumped.where("changed").isEmpty():
            return jumped.select("id", "ring")
        state = jumped.drop("changed")


def _steps_left(successors: DataFrame, rings: DataFrame) -> DataFrame:
    """``id``, ``ring`` and ``left``: how many edges follow until the ring's first one."""
    first = F.col("id") == F.col("ring")
    state = written(successors.join(rings, "id").select(
        "id", "ring", F.when(first, F.col("id")).otherwise(F.col("next")).alias("next"),
        F.when(first, 0).otherwise(1).cast("long").alias("left")), "steps")
    while not state.where("next <> ring").isEmpty():
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        state = written(state.join(ahead, "next").select(
            "id", "ring", F.col("then").alias("next"), (F.col("left") + F.col("more")).alias("left")), "steps")
    return state.drop("next")


def rings_of(edges: DataFrame) -> DataFrame:
    """Closed rings of directed edges whose inside is on the left: ``region``, ``ring``, ``points``, ``area``.

    Where several edges leave a point, parts that touch there are kept apart, and so are holes
    that touch their outer ring: edges are chained around one face first, then within it
    by the other turn.
    """
    numbered = written(edges.select("*", F.monotonically_increasing_id().alias("id")), "outline")
    faces = _smallest(_successors(numbered.withColumn("chain", F.col("region")), nearest=True))
    of_face = written(numbered.join(faces.withColumnRenamed("ring", "face"), "id"), "faces")
    successors = written(_successors(of_face.withColumn("chain", F.col("face")), nearest=False), "successors")
    ordered = _steps_left(successors, _smallest(successors))
    return of_face.join(ordered, "id").groupBy("region", "ring").agg(
        F.sort_array(F.collect_list(F.struct(
            F.when(F.col("id") == F.col("ring"), F.lit(-(1 << 62)).cast("long")).otherwise(-F.col("left")).alias("place"),
            F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p")))).alias("s")).select(
        "region", "ring", geometry.close_ring(F.col("s.p")).alias("points")).withColumn("area", _area(F.col("points")) / 2)


def dissolve(polygons: DataFrame, by: Sequence[str] = (), crowded: int = CROWDED, side: float = DEFAULT_SQUARE) -> DataFrame:
    """Parts of the union of each region's polygons: ``by`` columns, ``part``, ``rings`` and ``area``.

    A part's first ring runs counterclockwise around it, the others clockwise around its holes;
    parts share single points at most. ``part`` counts from 0 by falling area.
    """
    rings = written(rings_of(outline(polygons, by, crowded, side)), "rings")
    outer = rings.where("area > 0").select("region", "ring", "points", "area", F.array("points").alias("rings"))
    # A hole's edge lies strictly inside the part around it: only ends are shared.
    holes = rings.where("area < 0").select("region", F.col("ring").alias("hole"), "points", F.col("area").alias("hole_area"), *(
        ((F.col("points")[0][a] + F.col("points")[1][a]) / 2).alias(f"hole_{a}") for a in "xy"))
    placed = points_in_polygons(
        holes, outer.select("rings", "ring", F.col("region").alias("other_region"), F.col("area").alias("outer_area")),
        x="hole_x", y="hole_y", keep=("ring", "other_region", "outer_area"), side=side,
    ).where("region = other_region").groupBy("region", "hole").agg(
        F.min_by("ring", F.struct("outer_area", "ring")).alias("ring"), F.first("points").alias("points"),
        F.first("hole_area").alias("hole_area"))
    inner = placed.groupBy("ring").agg(F.sort_array(F.collect_list("points")).alias("holes"), F.sum("hole_area").alias("taken"))
    parts = outer.join(inner, "ring", "left").select(
        "region", "ring", F.concat(F.array("points"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("rings"),
        (F.col("area") + F.coalesce("taken", F.lit(0.0))).alias("area"))
    names = polygons.select(*by, _region(by).alias("region")).dropDuplicates(["region"])
    return parts.join(names, "region").selectExpr(
        *by, "row_number() over (partition by region order by area desc, rings) - 1 as part", "rings", "area")
