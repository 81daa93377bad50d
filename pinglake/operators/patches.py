"""Two-dimensional patches: resampling masks, filling holes, contours, polygons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from .asof import nearest_cell
from .blocks import index_block, join_facts, scan, shift, value_block, with_facts

KEY = ("transect_id",)
CHUNK = 1024  # pings labelled together in one task


def mask_onto_grid(masked: DataFrame, target: DataFrame, mask: str = "mask", key: Sequence[str] = KEY, ts: str = "ts_s",
                   rows: int | None = None) -> DataFrame:
    """A mask on another grid: bilinear, then set where above one half.

    ``target`` has pings with ``ts_s`` and the wanted grid in ``grid_start``,
    ``grid_stop``, ``grid_n``. Ends are held along both axes.
    """
    other = [c for c in target.columns if c not in (*key, ts)]
    t = target.select(*key, ts, F.struct(*other).alias("_row"))
    num = F.transform(mask, lambda x: x.cast("double"))
    m = masked.select(*key, ts, F.struct(F.col(ts).alias("x"), num.alias("m"), F.col("depth_start").alias("a"), F.col("depth_stop").alias("b")).alias("_p"))
    u = t.unionByName(m, allowMissingColumns=True)
    s = scan(value_block(u, key, ts, rows), key, [ts], {"_b": ("last", "_p"), "_a": ("next", "_p")}, blocked=True)
    s = s.where(F.col("_row").isNotNull()).withColumns({"_b": F.coalesce("_b", "_a"), "_a": F.coalesce("_a", "_b")})
    b, a = F.col("_b"), F.col("_a")
    f = F.when(a["x"] > b["x"], (F.col(ts) - b["x"]) / (a["x"] - b["x"])).otherwise(F.lit(0.0))
    s = s.withColumn("_m", F.zip_with(b["m"], a["m"], lambda p, q: p + (q - p) * f))
    step = (b["b"] - b["a"]) / (F.size("_m") - 1)

    def resampled(z):
        v, n = z["m"], F.size(z["m"])

        def at(d):
            raw = (d - z["a"]) / z["step"]
            near = F.bround(raw)
            x = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), F.when(F.abs(raw - near) < 1e-9, near).otherwise(raw)))
            lo = F.floor(x).cast("int")
            p = F.get(v, lo)
            q = F.coalesce(F.get(v, lo + 1), p)
            return p + (q - p) * (x - lo) > 0.5

        return F.transform(z["grid"], at)

    grid = A.linspace("_row.grid_start", "_row.grid_stop", F.col("_row.grid_n"))
    args = F.struct(F.col("_m").alias("m"), b["a"].alias("a"), step.alias("step"), grid.alias("grid"))
    return s.select(*key, ts, "_row.*", A.let(args, resampled).alias(mask))


# --- Connected cells ---


def _runs_of(row: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
    return list(zip(edge[::2], edge[1::2]))


def _label_rows(rows: list[np.ndarray], index: list[int]) -> tuple[np.ndarray, int]:
    """4-connected labels from 1 of the set cells of consecutive rows."""
    parent: list[int] = [0]

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    spans, above, last = [], [], None
    for r, (row, i) in enumerate(zip(rows, index)):
        here = []
        for a, b in _runs_of(row):
            parent.append(len(parent))
            me = len(parent) - 1
            if last is not None and i == last + 1:
                for c, d, other in above:
                    if c < b and a < d:
                        x, y = root(me), root(other)
                        parent[max(x, y)] = min(x, y)
            here.append((a, b, me))
            spans.append((r, a, b, me))
        above, last = here, i
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int32)
    for r, a, b, me in spans:
        out[r, a:b] = root(me)
    return out, len(parent)


def label_cells(df: DataFrame, cells: str, key: Sequence[str] = KEY, idx: str = "ping_index", chunk: int = CHUNK) -> DataFrame:
    """4-connected labels of set cells within chunks of ``chunk`` pings.

    Adds ``chunk`` and ``labels``, 0 for clear cells, unique within the chunk. Groups are
    bounded by the chunk length.
    """
    key = list(key)
    d = df.select(*key, idx, F.floor(F.col(idx) / chunk).cast("long").alias("chunk"), F.col(cells).alias("_c"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key, idx).schema.fields)

    def label(t: pa.Table) -> pa.Table:
        t = t.sort_by(idx).combine_chunks()
        cells, index = t.column("_c").combine_chunks(), t.column(idx).to_numpy()
        ends = np.concatenate(([0], np.cumsum(cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        flat = cells.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        lab, _ = _label_rows([flat[a:b] for a, b in zip(ends, ends[1:])], index.tolist())
        n, width = lab.shape
        labels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(lab.ravel()))
        return t.select([*key, idx, "chunk"]).append_column("labels", labels)

    return d.groupBy(*key, "chunk").applyInArrow(label, f"{fields}, chunk long, labels array<int>")


def _chunk_links(labelled: DataFrame, key, idx: str, chunk: int) -> DataFrame:
    """Pairs of labels that touch across the edge between two chunks."""
    key = list(key)
    z = lambda d: d.select(*key, "chunk", F.posexplode("labels").alias("j", "l")).where("l > 0")
    last = z(labelled.where(F.col(idx) % chunk == chunk - 1)).select(*key, "j", (F.col("chunk") + 1).alias("chunk"), F.col("l").alias("l0"))
    first = z(labelled.where(F.col(idx) % chunk == 0)).select(*key, "j", "chunk", F.col("l").alias("l1"))
    return last.join(first, [*key, "chunk", "j"]).select(*key, (F.col("chunk") - 1).alias("c0"), "l0", F.col("chunk").alias("c1"), "l1").distinct()


# The border of a recording as a label: below all others.
_BORDER = -1


def _label(c, l):  # noqa: E741
    return F.struct(F.col(c).alias("c"), F.col(l).alias("l"))


def _roots(edges: DataFrame, key, border: DataFrame | None = None) -> DataFrame:
    """(u, r): the smallest label that each label in ``edges`` (u, v, both ways) reaches.

    Labels in ``border`` touch the border, which is smaller than all. A round takes the smallest
    root among a label's neighbours, hands it to the label's own root, and follows what that has
    learnt, so reach doubles and an area over n chunks settles in about log2(n) rounds. A label that has reached the border is
    done: it is looked at by its neighbours only, so the border itself, which may touch most
    labels, is never a key of a join.
    """
    key = list(key)
    best = edges.groupBy(*key, "u").agg(F.least(F.min("v"), F.first("u")).alias("r"))
    if border is not None:
        on = border.select(*key, "u", F.lit(True).alias("_on"))
        best = best.join(on, [*key, "u"], "full_outer")
        end = F.struct(F.lit(_BORDER).cast("long").alias("c"), F.lit(0).alias("l"))
        best = best.select(*key, "u", F.when(F.col("_on"), end).otherwise(F.col("r")).alias("r"))
    best = cut(best, "roots")
    while not best.isEmpty():
        near = edges.join(best.select(*key, F.col("u").alias("v"), F.col("r").alias("rv")), [*key, "v"]).groupBy(*key, "u").agg(F.min("rv").alias("rn"))
        jump = best.select(*key, F.col("u").alias("r"), F.col("r").alias("rr"))
        done, still = best.where(F.col("r.c") == _BORDER), best.where(F.col("r.c") != _BORDER)
        still = still.join(near, [*key, "u"], "left")
        hung = still.where("rn < r").groupBy(*key, F.col("r").alias("u")).agg(F.min("rn").alias("rh"))
        new = still.join(hung, [*key, "u"], "left").join(jump, [*key, "r"], "left")
        least = F.least("r", "rn", "rr", "rh")
        new = new.select(*key, "u", least.alias("r"), (least < F.col("r")).alias("changed"))
        new = cut(new.unionByName(done.withColumn("changed", F.lit(False))), "roots")
        moved = not new.where("changed").isEmpty()
        best = new.drop("changed")
        if not moved:
            break
    return best


def _edges(labelled: DataFrame, key, idx: str, chunk: int) -> DataFrame:
    links = _chunk_links(labelled, key, idx, chunk)
    a, b = _label("c0", "l0"), _label("c1", "l1")
    return cut(links.select(*key, a.alias("u"), b.alias("v")).unionByName(links.select(*key, b.alias("u"), a.alias("v"))), "links")


def fill_enclosed(df: DataFrame, mask: str = "mask", out: str | None = None, key: Sequence[str] = KEY, idx: str = "ping_index",
                  chunk: int = CHUNK) -> DataFrame:
    """Set the clear cells that no 4-connected path of clear cells joins to the border.

    Clear areas are labelled per chunk; those touching the border of the recording are
    outside. Areas open only at a chunk edge are outside if the labels they are linked to
    lead to the border. Only labels at chunk edges take part in the rounds.
    """
    out = out or mask
    key = list(key)
    clear = df.withColumn("_clear", F.transform(mask, lambda x: ~F.coalesce(x, F.lit(False))))
    lab = cut(label_cells(clear, "_clear", key, idx, chunk), "labels")
    n = lab.groupBy(*key).agg(F.max(idx).alias("_last"), F.min(idx).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    edge = with_facts(lab, n, key, "_rows").withColumn(
        "_on",
        F.when((F.col(idx) == F.col("_first")) | (F.col(idx) == F.col("_last")), F.array_distinct("labels")).otherwise(
            F.array(F.get("labels", F.lit(0)), F.get("labels", F.size("labels") - 1))
        ),
    )
    border = edge.select(*key, "chunk", F.explode("_on").alias("l")).where("l > 0").distinct().select(*key, _label("chunk", "l").alias("u"))
    roots = _roots(_edges(lab, key, idx, chunk), key, cut(border, "border"))
    # One set of outside labels per chunk: no larger than the chunk's border.
    outside = roots.where(F.col("r.c") == _BORDER).groupBy(*key, F.col("u.c").alias("chunk")).agg(F.collect_set("u.l").alias("_out"))
    filled = lab.join(outside, [*key, "chunk"], "left").select(
        *key, idx, F.transform("labels", lambda x: (x == 0) | ~F.coalesce(F.array_contains("_out", x), F.lit(False))).alias("_filled")
    )
    return df.join(filled, [*key, idx]).withColumn(out, F.col("_filled")).drop("_filled")


def components(df: DataFrame, mask: str, key: Sequence[str] = KEY, idx: str = "ping_index", chunk: int = CHUNK) -> DataFrame:
    """Labels of 4-connected set cells over whole recordings.

    Adds array ``patch``: chunk and label of the patch's smallest member (NULL where clear).
    """
    key = list(key)
    lab = cut(label_cells(df, mask, key, idx, chunk), "labels")
    best = _roots(_edges(lab, key, idx, chunk), key)
    per = best.groupBy(*key, F.col("u.c").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("u.l"), F.col("r")))).alias("_m"))
    d = lab.join(per, [*key, "chunk"], "left")
    root = lambda x: F.coalesce(F.try_element_at("_m", x), F.struct(F.col("chunk").alias("c"), x.alias("l")))
    d = d.select(*key, idx, F.transform("labels", lambda x: F.when(x > 0, root(x))).alias("patch"))
    return df.join(d, [*key, idx])


# --- Contours ---

# Contour pieces of a square of four cells (marching squares at one half).
# Corners: 1 (i, j), 2 (i, j+1), 4 (i+1, j), 8 (i+1, j+1). Each piece runs between two
# mid-edges, in half-cell steps (di, dj) from the square's first corner, with the set cells
# on one side. Where two opposite corners are set they stay apart.
_T, _L, _R, _B = (0, 1), (1, 0), (1, 2), (2, 1)
_PIECES = {
    1: [(_T, _L)],
    2: [(_R, _T)],
    3: [(_R, _L)],
    4: [(_L, _B)],
    5: [(_T, _B)],
    6: [(_R, _T), (_L, _B)],
    7: [(_R, _B)],
    8: [(_B, _R)],
    9: [(_T, _L), (_B, _R)],
    10: [(_B, _T)],
    11: [(_B, _L)],
    12: [(_L, _R)],
    13: [(_T, _R)],
    14: [(_L, _T)],
}
_CORNERS = {1: (0, 0), 2: (0, 1), 4: (1, 0), 8: (1, 1)}


def _piece_owner(case: int, k: int) -> int:
    """Corner that tells which patch a piece belongs to."""
    if case in (6, 9):
        return {6: (2, 4), 9: (1, 8)}[case][k]
    return next(c for c in (1, 2, 4, 8) if case & c)


def contour_pieces(df: DataFrame, mask: str, key: Sequence[str] = KEY, idx: str = "ping_index", rows: int | None = None) -> DataFrame:
    """Contour pieces of every patch: ``x0,y0`` to ``x1,y1`` in cells (ping, depth).

    Needs ``patch`` from ``components``. Only squares on a patch's edge leave the row.
    """
    d = shift(df.select(*key, idx, mask, "patch"), key, {"_m1": (mask, -1), "_p1": ("patch", -1)}, idx, rows)
    d = d.where(F.col("_m1").isNotNull())
    m0, m1 = F.col(mask), F.col("_m1")
    bit = lambda m, j: F.coalesce(F.get(m, j), F.lit(False)).cast("int")
    j = F.sequence(F.lit(0), F.size(mask) - 2)
    squares = F.filter(
        F.transform(j, lambda i: F.struct(i.alias("j"), (bit(m0, i) + 2 * bit(m0, i + 1) + 4 * bit(m1, i) + 8 * bit(m1, i + 1)).alias("case"))),
        lambda s: (s["case"] > 0) & (s["case"] < 15),
    )
    d = d.select(*key, idx, "patch", "_p1", F.explode(squares).alias("_s"))
    table = F.create_map(
        *[
            x
            for case, pieces in _PIECES.items()
            for x in (
                F.lit(case),
                F.array(
                    *[
                        F.struct(
                            *[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), (*p, *q))],
                            F.lit(_CORNERS[_piece_owner(case, k)][0]).alias("oi"),
                            F.lit(_CORNERS[_piece_owner(case, k)][1]).alias("oj"),
                        )
                        for k, (p, q) in enumerate(pieces)
                    ]
                ),
            )
        ]
    )
    d = d.withColumn("_e", F.explode(F.element_at(table, F.col("_s.case"))))
    owner = F.when(F.col("_e.oi") == 0, F.get("patch", F.col("_s.j") + F.col("_e.oj"))).otherwise(F.get("_p1", F.col("_s.j") + F.col("_e.oj")))
    return d.select(
        *key,
        owner.alias("patch"),
        (F.col(idx) + F.col("_e.a") / 2).alias("x0"),
        (F.col("_s.j") + F.col("_e.b") / 2).alias("y0"),
        (F.col(idx) + F.col("_e.c") / 2).alias("x1"),
        (F.col("_s.j") + F.col("_e.d") / 2).alias("y1"),
    )


# A point of a contour as one number that sorts by ping, then depth; coordinates are halves.
_DEPTHS = 1 << 21


def _code(x: str, y: str):
    return (F.col(x) * 2 * _DEPTHS + F.col(y) * 2).cast("long")


def linked(pieces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Contour and place of every piece: columns key, ``at``, ``contour`` and ``pos``.

    ``pieces`` go from the point ``at`` to the point ``to``; at most one begins and one ends at a
    point. A contour is named by the point it starts from: the free one if it is open, else its
    smallest. Every piece points to the one before it; a pointer takes over what lies behind the
    piece it leads to, so reach doubles, and a contour of n pieces takes log2(n) steps. Pieces
    are rows throughout, and as each is pointed to by one other only, no key is hot.
    """
    key = list(key)
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    before = pieces.select(*key, F.col("to").alias("at"), F.col("at").alias("back"))
    s = pieces.select(*key, "at").join(before, [*key, "at"], "left")
    # A stretch of `steps` pieces that ends here: the one before it, its free start if it has one, its smallest point and how far back that is.
    s = s.select(*key, "at", "back", one.alias("steps"), F.when(F.col("back").isNull(), F.col("at")).alias("free"), F.col("at").alias("low"), (one - 1).alias("low_at"))

    def doubled(s: DataFrame) -> DataFrame:
        behind = s.select(*key, F.col("at").alias("back"), *[F.col(c).alias(f"_{c}") for c in ("back", "steps", "free", "low", "low_at")])
        j = s.join(behind, [*key, "back"], "left")
        return j.select(
            *key, "at", F.col("_back").alias("back"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("free", "_free").alias("free"),
            F.least("low", "_low").alias("low"), F.when(F.col("_low") < F.col("low"), F.col("steps") + F.col("_low_at")).otherwise(F.col("low_at")).alias("low_at"), "_moved",
        )

    s = cut(s, "pieces")
    while True:
        # Done when no smaller point turns up and no start is reached: then every stretch covers its contour.
        mark = F.struct("low", "free").alias("_moved")
        s = cut(doubled(doubled(s.select("*", mark))).withColumn("_moved", ~F.col("_moved").eqNullSafe(F.struct("low", "free"))), "linked")
        moved = not s.where("_moved").isEmpty()
        s = s.drop("_moved")
        if not moved:
            break
    return s.select(*key, "at", F.coalesce("free", "low").alias("contour"), F.when(F.col("free").isNotNull(), F.col("steps") - 1).otherwise(F.col("low_at")).alias("pos"))


def contours(df: DataFrame, mask: str = "mask_patches", min_area: float = 0, key: Sequence[str] = KEY,
             idx: str = "ping_index", ts: str = "ts_s", name_suffix: str = "", chunk: int = CHUNK,
             rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Patches as contours: a table of regions and a table of their points in order (``number``, ``seq``).

    Enclosed holes are filled, contours run at one half between cell centres, positions
    become time and depth by linear interpolation, and contours with an area (in cells)
    below ``min_area`` are dropped (-1 drops all). A contour ends open at the border. Points
    stay rows: figures of a contour are sums over its pieces, whatever its length.
    """
    key = list(key)
    base = df.select(*key, idx, ts, "depth_start", "depth_stop", F.transform(mask, lambda x: F.coalesce(x, F.lit(False))).alias(mask))
    d = components(cut(fill_enclosed(base, mask, key=key, idx=idx, chunk=chunk), "filled"), mask, key, idx, chunk)
    d = cut(d, "patches")
    pieces = contour_pieces(d, mask, key, idx, rows).drop("patch")
    if min_area == -1:
        pieces = pieces.where(F.lit(False))
    # Time of the half ping positions, taken along to the points.
    t = shift(d.select(*key, idx, ts), key, {"_n": (ts, -1)}, idx, rows).select(*key, F.col(idx).alias("_i"), F.col(ts).alias("_t"), (F.coalesce("_n", ts) - F.col(ts)).alias("_dt"))
    pieces = pieces.withColumn("_i", F.floor("x0").cast("long")).join(t, [*key, "_i"])
    pieces = pieces.withColumn("t0", F.col("_t") + (F.col("x0") - F.col("_i")) * F.col("_dt"))
    pieces = pieces.withColumn("_i", F.floor("x1").cast("long")).drop("_t", "_dt").join(t, [*key, "_i"])
    pieces = pieces.withColumn("t1", F.col("_t") + (F.col("x1") - F.col("_i")) * F.col("_dt")).drop("_t", "_dt", "_i")
    grid = d.groupBy(*key).agg(F.first("depth_start").alias("_a"), F.first("depth_stop").alias("_b"), F.max(F.size(mask)).alias("_n"), F.min(ts).alias("_t"))
    pieces = join_facts(pieces, grid, key)
    depth = lambda y: F.col("_a") + F.col(y) * (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)
    pieces = cut(pieces.select(*key, _code("x0", "y0").alias("at"), _code("x1", "y1").alias("to"), "x0", "y0", "x1", "y1", "t0", depth("y0").alias("d0"), "t1", depth("y1").alias("d1"), F.col("_t").alias("ref")), "pieces")
    placed = cut(pieces.join(linked(pieces, key), [*key, "at"]), "contour-pieces")
    # Twice the area left of a piece, seen from the origin; times from the start of the recording, to keep digits.
    turn = lambda x0, y0, x1, y1: y0 * (x1 - x0) - x0 * (y1 - y0)
    c = F.col
    whole = placed.groupBy(*key, "contour").agg(
        F.count("*").alias("n"), F.sum(turn(c("x0"), c("y0"), c("x1"), c("y1"))).alias("_a"), F.sum(turn(c("t0") - c("ref"), c("d0"), c("t1") - c("ref"), c("d1"))).alias("_ts"),
        F.min_by(F.struct("x0", "y0", "t0", "d0", "ref"), "pos").alias("_f"), F.max_by(F.struct("x1", "y1", "t1", "d1"), "pos").alias("_l"), F.ceil(F.least(F.min("x0"), F.min("x1"))).alias("first"),
        F.least(F.min("t0"), F.min("t1")).alias("ts_start"), F.greatest(F.max("t0"), F.max("t1")).alias("ts_end"),
        F.least(F.min("d0"), F.min("d1")).alias("top"), F.greatest(F.max("d0"), F.max("d1")).alias("low"),
    )
    # An open contour is closed by the way back to its start.
    f, z = c("_f"), c("_l")
    area = F.abs(c("_a") + turn(z["x1"], z["y1"], f["x0"], f["y0"])) / 2
    area_ts = F.abs(c("_ts") + turn(z["t1"] - f["ref"], z["d1"], f["t0"] - f["ref"], f["d0"])) / 2
    whole = cut(whole.withColumns({"area": area, "area_ts": area_ts, "x_first": f["x0"], "y_first": f["y0"]}).where(F.col("area") >= min_area), "contours")
    whole = scan(index_block(whole.withColumn("_one", F.lit(1)), "x_first", rows), key, ["x_first", "y_first"], {"number": ("sum", "_one")}, blocked=True)
    whole = cut(whole.withColumn("number", F.col("number").cast("long")), "numbered")
    regions = whole.select(
        *key,
        F.lit("patch").alias("kind"),
        "number",
        "area",
        "area_ts",
        F.col("first").cast("long").alias("first"),
        (F.col("n") + 1).cast("int").alias("n_points"),
        "ts_start",
        "ts_end",
        "top",
        "low",
        F.concat(F.lit(f"Removed patch{name_suffix} "), F.col("number").cast("string")).alias("region_name"),
        F.format_string(
            "Removed patch\nArea in pixels: %s\nArea in meter-seconds: %s", F.col("area").cast("string"), F.col("area_ts").cast("string")
        ).alias("notes"),
        F.lit(2).alias("creation_type"),
        F.lit(0).alias("region_type"),
    )
    points = placed.join(whole.select(*key, "contour", "number"), [*key, "contour"]).select(*key, "number", F.col("pos").alias("seq"), F.col("t0").alias("ts_s"), F.col("d0").alias("depth"))
    ends = whole.select(*key, "number", F.col("n").alias("seq"), z["t1"].alias("ts_s"), z["d1"].alias("depth"))
    return regions, points.unionByName(ends)


def patch_contours(df: DataFrame, mask: str = "mask_patches", min_area: float = 0, key: Sequence[str] = KEY,
                   idx: str = "ping_index", ts: str = "ts_s", name_suffix: str = "", chunk: int = CHUNK,
                   rows: int | None = None) -> DataFrame:
    """Contours as a region file holds them: one row per region, which lists its points.

    The row of a very long contour is as long as its line in the file; ``contours`` has the points as rows.
    """
    key = list(key)
    regions, points = contours(df, mask, min_area, key, idx, ts, name_suffix, chunk, rows)
    listed = points.groupBy(*key, "number").agg(F.array_sort(F.collect_list(F.struct("seq", "ts_s", "depth"))).alias("points"))
    return regions.join(listed, [*key, "number"]).withColumn("points", F.transform("points", lambda p: F.struct(p["ts_s"].alias("ts_s"), p["depth"].alias("depth"))))


# --- Polygons as rows of points ---


def polygon_area(points: DataFrame, key: Sequence[str], order: str, x: str, y: str, closed: bool | None = None) -> DataFrame:
    """Area of each polygon given as ordered points (Green's theorem), always positive.

    With ``closed`` None or False the last point is joined to the first (which changes
    nothing if they coincide). ``order`` counts from 0 without gaps. The sum over edges
    needs no order of its own, so it is an ordinary aggregate.
    """
    d = shift(points.select(*key, order, x, y), key, {"_x": (x, -1), "_y": (y, -1)}, order)
    first = points.where(F.col(order) == 0).select(*key, F.col(x).alias("_fx"), F.col(y).alias("_fy"))
    d = d.join(first, list(key))
    if closed:
        d = d.where(F.col("_x").isNotNull())
    nx, ny = F.coalesce("_x", "_fx"), F.coalesce("_y", "_fy")
    # Taken relative to the first point: same area, fewer digits lost.
    x0, y0 = F.col(x) - F.col("_fx"), F.col(y) - F.col("_fy")
    return d.groupBy(*key).agg((F.abs(F.sum(y0 * (nx - F.col(x)) - x0 * (ny - F.col(y)))) / 2).alias("area"))


def polygon_regions(points: DataFrame, key: Sequence[str], order: str, ts: str = "ts_s", depth: str = "depth") -> DataFrame:
    """Bounding box, point count and area of polygons."""
    box = points.groupBy(*key).agg(
        F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end"), F.min(depth).alias("top"), F.max(depth).alias("low"),
        F.count(F.lit(1)).alias("n_points"),
    )
    return box.join(polygon_area(points, key, order, ts, depth), list(key))


def patches_to_cells(pings: DataFrame, regions: DataFrame, key: Sequence[str] = KEY, idx: str = "ping_index", ts: str = "ts_s",
                     out: str = "mask_patches", draw_edges: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Cells covered by patch regions: vertices to cells, set, enclosed cells filled, united.

    ``pings`` has increasing depth in ``depth_start``/``depth_stop``/``sv``; ``regions`` has
    ``number`` and ``points``. Each region is drawn and filled on its own, over its own
    span of pings. ``draw_edges`` also sets the cells between successive vertices.
    """
    key = list(key)
    n = pings.groupBy(*key).agg((F.max(idx) + 1).alias("_n"), F.first("depth_start").alias("_a"), F.first("depth_stop").alias("_b"), F.max(F.size("sv")).alias("_nd"))
    last = pings.select(*key, idx, ts).join(n.select(*key, "_n"), key).where(F.col(idx) >= F.col("_n") - 2).groupBy(*key).agg((F.max(ts) - F.min(ts)).alias("_dt"))
    v = regions.select(*key, "number", F.posexplode("points").alias("_o", "_p")).select(*key, "number", "_o", F.col("_p.ts_s").alias("_t"), F.col("_p.depth").alias("_d"))
    v = v.join(n, key)
    step = F.abs(F.col("_b") - F.col("_a")) / (F.col("_nd") - 1)
    raw = (F.col("_d") - F.least("_a", "_b")) / step - 0.5
    near = F.bround(raw)
    v = v.withColumn("j", F.greatest(F.lit(0), F.least(F.col("_nd") - 1, F.ceil(F.when(F.abs(raw - near) < 1e-9, near).otherwise(raw)))).cast("int"))
    g = pings.select(*key, idx, ts).join(last, key).withColumn("_half", F.col("_dt") / 2)
    v = cut(nearest_cell(v.drop("_a", "_b"), g, key, "_t", ts, idx, "i", "_half"), "vertices")
    v = v.withColumn("i", F.least(F.col("i"), F.col("_n") - 1))
    if draw_edges:
        s = shift(v, [*key, "number"], {"_ni": ("i", -1), "_nj": ("j", -1)}, "_o")
        steps = F.greatest(F.abs(F.col("_ni") - F.col("i")), F.abs(F.col("_nj") - F.col("j")), F.lit(1))
        s = s.withColumn("_k", F.explode(F.when(F.col("_ni").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), steps.cast("long")))))
        f = F.coalesce(F.col("_k") / steps, F.lit(0.0))
        v = s.withColumns({"i": (F.col("i") + F.bround(f * (F.coalesce("_ni", "i") - F.col("i")))).cast("long"),
                           "j": (F.col("j") + F.bround(f * (F.coalesce("_nj", "j") - F.col("j")))).cast("int")})
    # Rows of a region's own span, with one clear row and column around it as the border.
    rows_ = v.groupBy(*key, "number", "i").agg(F.collect_set("j").alias("_js"), F.max("_nd").alias("_nd"))
    span = v.groupBy(*key, "number").agg(F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.max("_nd").alias("_nd"))
    r = span.select(*key, "number", "_nd", "_i0", F.explode(F.sequence(F.col("_i0") - 1, F.col("_i1") + 1)).alias("i"))
    r = r.join(rows_.drop("_nd"), [*key, "number", "i"], "left")
    cell = lambda j: F.coalesce(F.array_contains("_js", j.cast("int") - 1), F.lit(False))
    r = r.select(*key, "number", (F.col("i") - F.col("_i0") + 1).alias("_r"), "i", F.transform(F.sequence(F.lit(0), F.col("_nd") + 1), cell).alias("_m"))
    r = fill_enclosed(cut(r, "drawn"), "_m", key=[*key, "number"], idx="_r", chunk=chunk)
    # A cell is covered if any region covers it; regions are united before the join back.
    cover = r.select(*key, F.col("i").alias(idx), F.posexplode(F.slice("_m", F.lit(2), F.size("_m") - 2)).alias("j", "_s")).where("_s")
    cover = cover.select(*key, idx, "j").distinct().groupBy(*key, idx).agg(F.collect_list("j").alias("_js"))
    d = pings.join(cover, [*key, idx], "left")
    return d.withColumn(out, F.transform("sv", lambda _, j: F.coalesce(F.array_contains("_js", j.cast("int")), F.lit(False)))).drop("_js")


def regions_to_masks(pings: DataFrame, rectangles: DataFrame, patches: DataFrame | None = None, key: Sequence[str] = KEY,
                     idx: str = "ping_index", ts: str = "ts_s") -> DataFrame:
    """Flags and masks from regions: ``is_passive``, ``is_removed``, ``mask_patches``, ``mask``."""
    from .asof import flag_in_intervals  # noqa: PLC0415

    d = pings.drop("is_passive", "is_removed", "mask", "mask_patches")
    for kind in ("passive", "removed"):
        d = flag_in_intervals(d, rectangles.where(F.col("kind") == kind), key, ts, "ts_start", "ts_end", f"is_{kind}")
        d = cut(d, "flagged")
    if patches is not None:
        d = patches_to_cells(d, patches, key, idx, ts)
    else:
        d = d.withColumn("mask_patches", F.transform("sv", lambda x: F.lit(False)))
    gone = F.col("is_passive") | F.col("is_removed")
    return d.withColumn("mask", F.transform("mask_patches", lambda p: ~p & ~gone))
