"""Finding passive (silent) stretches of a recording.

A stretch starts where the signal near the sounder drops from one ping to the next and
ends where it is back at the level of a baseline ping. The reading is greedy from left to
right, but where a candidate's stretch would end depends on the signal alone. So ends
are searched for all candidates at once, in windows that double until each is found, and
the choice among overlapping candidates follows pointers that double their reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from .blocks import index_block, scan, shift
from .quantiles import quantiles
from .runs import numbered_runs
from .smooth import gaussian_depth, gaussian_time

KEY = ("transect_id",)
N_USE = 38  # fixed value: samples nearest the sounder used by default


def near_samples(df: DataFrame, n_use: int | None = N_USE, key: Sequence[str] = KEY, idx: str = "ping_index", value: str = "sv") -> DataFrame:
    """Only what the search needs: the first samples of each ping, as ``x``."""
    x = F.col(value) if n_use is None else F.slice(value, 1, n_use)
    return df.select(*key, idx, x.alias("x"))


def median_step(df: DataFrame, key: Sequence[str] = KEY, idx: str = "ping_index", col: str = "x", out: str = "step",
                rows: int | None = None) -> DataFrame:
    """Median over samples of the change from the previous ping; NULL if any is missing."""
    d = shift(df, key, {"_px": (col, 1)}, idx, rows)
    return d.withColumn(out, A.array_median(F.zip_with(col, "_px", lambda a, b: a - b))).drop("_px")


def _exclusive_max(df: DataFrame, key, order: str, value: str, out: str, rows=None) -> DataFrame:
    """Largest value among rows with a smaller order."""
    a = df.withColumns({"_rank": F.lit(0), "_val": F.lit(None).cast("long")})
    b = df.select(*key, order, F.lit(1).alias("_rank"), F.col(value).cast("long").alias("_val"), F.lit(True).alias("_event"))
    u = index_block(a.withColumn("_event", F.lit(False)).unionByName(b, allowMissingColumns=True), order, rows)
    s = scan(u, key, [order, "_rank"], {out: ("max", "_val")}, blocked=True)
    return s.where(~F.col("_event")).drop("_rank", "_val", "_event")


def _look(todo: DataFrame, p: DataFrame, key, thr: Column, forward: bool, window: int) -> DataFrame:
    """One round of a search: ``hit`` is the nearest ping in the next ``width`` whose level is back at the baseline.

    ``p``: pings by block of ``window``. Adds ``_lo`` and ``_hi``, the pings looked at.
    """
    lo = F.col("pos") if forward else F.greatest(F.col("pos") - (F.col("width") - 1), F.lit(0))
    hi = F.least(F.col("pos") + (F.col("width") - 1), F.col("n") - 1) if forward else F.col("pos")
    t = todo.drop("hit").withColumns({"_lo": lo, "_hi": hi})
    spread = t.where(F.col("_lo") <= F.col("_hi")).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / window).cast("long"), F.floor(F.col("_hi") / window).cast("long")))
    )
    back = A.array_median(F.zip_with("base", "_x", lambda a, b: a - b)) < thr
    m = spread.join(p, [*key, "_b"]).where(F.col("_i").between(F.col("_lo"), F.col("_hi"))).where(back)
    hits = m.groupBy(*key, "cid").agg((F.min("_i") if forward else F.max("_i")).cast("long").alias("hit"))
    return t.join(hits, [*key, "cid"], "left")


def _blocks_of(pings: DataFrame, key, idx: str, window: int) -> DataFrame:
    return pings.select(*key, F.col(idx).alias("_i"), F.col("x").alias("_x"), F.floor(F.col(idx) / window).cast("long").alias("_b"))


def _search(cands: DataFrame, pings: DataFrame, key, idx: str, thr: Column, forward: bool, window: int) -> DataFrame:
    """Nearest ping whose level is back at the candidate's baseline.

    ``cands``: key, ``cid``, ``base`` (samples), ``pos`` (first ping looked at), ``n``,
    ``thr``. Adds ``hit`` (NULL when there is none). Each round looks at the next window
    of pings, twice as wide as the last, for the candidates not yet answered.
    """
    key = list(key)
    p = _blocks_of(pings, key, idx, window)
    todo, found = cands.withColumns({"hit": F.lit(None).cast("long"), "width": F.lit(window).cast("long")}), []
    while True:
        r = cut(_look(todo, p, key, thr, forward, window))
        over = (F.col("_hi") >= F.col("n") - 1) if forward else (F.col("_lo") <= 0)
        open_ = F.col("hit").isNull() & ~over
        found.append(r.where(~open_).drop("_lo", "_hi", "width"))
        rest = r.where(open_)
        if rest.isEmpty():
            break
        todo = rest.withColumns({"pos": F.col("_hi") + 1 if forward else F.col("_lo") - 1, "width": F.col("width") * 2}).drop("_lo", "_hi")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _greedy(starts: DataFrame, pings: DataFrame, key, idx: str, thr: Column, window: int, rows) -> DataFrame:
    """Taken starts ``s`` with their ends ``e`` (``n`` if the level never returns).

    As far as it has been looked, a stretch without end reaches at least there. After each
    round the greedy choice is made with the reaches known so far, and only the starts that
    it takes are looked at further: they do not overlap, so a round reads each ping about once
    however many starts a long stretch covers. A start that was covered by one which another
    then covers comes back by itself, since the choice is made anew every time.
    """
    key = list(key)
    p = _blocks_of(pings, key, idx, window)
    state = starts.withColumns({"hit": F.lit(None).cast("long"), "width": F.lit(window).cast("long")})
    todo, rest = state, None
    while True:
        r = _look(todo, p, key, thr, True, window)
        r = r.withColumns({"pos": F.when(F.col("hit").isNull(), F.greatest(F.col("_hi") + 1, "pos")).otherwise(F.col("pos")), "width": F.col("width") * 2}).drop("_lo", "_hi")
        state = cut(r if rest is None else r.unionByName(rest), "stretches")
        reach = F.coalesce("hit", F.when(F.col("pos") >= F.col("n"), F.col("n")).otherwise(F.greatest(F.col("pos") - 1, "cid")))
        taken = cut(_choose(state.select(*key, F.col("cid").alias("s"), reach.cast("long").alias("e")), key, rows), "taken")
        alive = taken.select(*key, F.col("s").alias("cid"))
        unsure = F.col("hit").isNull() & (F.col("pos") < F.col("n"))
        todo = cut(state.join(alive, [*key, "cid"], "left_semi").where(unsure), "open")
        if todo.isEmpty():
            return taken.join(state.select(*key, F.col("cid").alias("s"), "n", "thr"), [*key, "s"])
        rest = state.join(todo.select(*key, "cid"), [*key, "cid"], "left_anti")


def candidates(df: DataFrame, threshold: float | None = 25.0, deviation: float | None = None, n_use: int | None = N_USE,
               key: Sequence[str] = KEY, idx: str = "ping_index", rows: int | None = None) -> DataFrame:
    """Pings where the level drops (``is_start``) or rises (``is_end``) by more than the threshold."""
    if (threshold is None) == (deviation is None):
        raise ValueError("set exactly one of threshold and deviation")
    md = median_step(near_samples(df, n_use, key, idx), key, idx, rows=rows).drop("x")
    if deviation is not None:
        md = cut(md, "steps")
        q = quantiles(md, key, "step", [0.25, 0.75], rows=rows).select(
            *key, ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) * deviation).alias("thr")
        )
        md = md.join(q, list(key), "left")
    else:
        md = md.withColumn("thr", F.lit(float(threshold)))
    c = md.select(*key, idx, (F.col("step") < -F.col("thr")).alias("is_start"), (F.col("step") > F.col("thr")).alias("is_end"), "thr")
    return c.where(F.col("is_start") | F.col("is_end"))


def _next_starts(d: DataFrame, key, rows) -> DataFrame:
    """Starts with the first start beyond their end (``to``), where that is no head."""
    key = list(key)
    # Ends are looked up once each: of a position there are two rows at most, however many starts end there.
    at = d.select(*key, F.col("s").alias("_at"), F.lit(0).alias("_rank"), F.struct("s", "_head").alias("_to"))
    ends = d.select(*key, F.col("e").alias("_at")).distinct().withColumns({"_rank": F.lit(1), "_to": F.lit(None).cast(at.schema["_to"].dataType)})
    u = scan(index_block(at.unionByName(ends), "_at", rows), key, ["_at", "_rank"], {"to": ("next", "_to")}, blocked=True)
    after = u.where((F.col("_rank") == 1) & ~F.col("to._head")).select(*key, F.col("_at").alias("e"), F.col("to.s").alias("to"))
    return d.join(after, [*key, "e"]).select(*key, "s", "to")


def _choose(starts: DataFrame, key, rows) -> DataFrame:
    """Greedy choice: each taken start rules out the starts up to its end ``e``.

    A start beyond all earlier ends is taken whatever happened before: it is a head. The others
    that are taken are those reached from a head by going from a start to the first one beyond its
    end. Pointers double their reach every round, so a chain of n starts takes log2(n) rounds;
    starts that nothing points to any more are left behind.
    """
    key = list(key)
    d = _exclusive_max(starts, key, "s", "e", "_pm", rows)
    d = cut(d.select(*key, "s", "e", (F.col("_pm").isNull() | (F.col("_pm") < F.col("s"))).alias("_head")), "starts")
    jump = cut(_next_starts(d, key, rows), "jumps")
    reached = d.where("_head").select(*key, "s")
    while True:
        more = cut(reached.join(jump, [*key, "s"]).select(*key, F.col("to").alias("s")), "reached")
        if more.isEmpty():
            return d.join(reached, [*key, "s"], "left_semi").select(*key, "s", "e")
        reached = reached.unionByName(more)
        # Beyond what is reached, only what a pointer leads to can still be.
        alive = reached.unionByName(jump.select(*key, F.col("to").alias("s"))).distinct()
        ahead = jump.select(*key, F.col("s").alias("to"), F.col("to").alias("_far"))
        jump = cut(jump.join(alive, [*key, "s"], "left_semi").join(ahead, [*key, "to"]).select(*key, "s", F.col("_far").alias("to")), "jumps")


def _stretches(cands: DataFrame, near: DataFrame, key, idx, before: int, after: int, window: int, rows) -> DataFrame:
    """Stretches from candidate starts and ends; see the module text."""
    key = list(key)
    cands = cut(cands, "candidates")
    n = near.groupBy(*key).agg((F.max(idx) + 1).alias("n"))
    first = cands.groupBy(*key).agg(
        F.min(F.when(F.col("is_end"), F.col(idx))).alias("_e0"), F.min(F.when(F.col("is_start"), F.col(idx))).alias("_s0")
    )
    lead = first.where(F.col("_e0").isNotNull() & (F.col("_s0").isNull() | (F.col("_e0") < F.col("_s0")))).select(*key, F.col("_e0").alias("e"))
    starts = cands.where("is_start").select(*key, F.col(idx).cast("long").alias("s"), "thr")
    starts = starts.join(lead, key, "left").where(F.col("e").isNull() | (F.col("s") > F.col("e"))).drop("e").join(n, key)

    def with_base(d, at):
        b = near.select(*key, F.col(idx).cast("long").alias("_at"), F.col("x").alias("base"))
        return d.withColumn("_at", at.cast("long")).join(b, [*key, "_at"]).drop("_at")

    fwd = with_base(starts, F.greatest(F.lit(0), F.col("s") - before)).select(*key, F.col("s").alias("cid"), "base", F.col("s").alias("pos"), "n", "thr")
    kept = cut(_greedy(fwd, near, key, idx, F.col("thr"), window, rows), "kept")
    inner = kept.where(F.col("e") < F.col("n"))
    back = with_base(inner, F.least(F.col("n") - 1, F.col("e") + after)).select(
        *key, F.col("s").alias("cid"), "base", (F.col("e") - 1).alias("pos"), "n", "thr"
    )
    back = _search(back, near, key, idx, F.col("thr"), False, window).select(*key, F.col("cid").alias("s"), F.coalesce(F.col("hit") + 1, F.lit(0)).alias("_q"))
    kept = kept.join(back, [*key, "s"], "left").select(*key, "s", "e", F.coalesce(F.least("s", "_q"), "s").cast("long").alias("start"))
    lead = lead.select(*key, F.lit(0).cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.lit(0).cast("long").alias("start"))
    allk = cut(lead.unionByName(kept), "kept")
    d = _exclusive_max(allk, key, "s", "e", "_pe", rows)
    d = d.withColumn("_new", F.when(F.col("_pe").isNull() | (F.col("start") > F.col("_pe")), 1).otherwise(0))
    d = scan(index_block(d, "s", rows), key, ["s"], {"_g": ("sum", "_new")}, blocked=True)
    return d.groupBy(*key, "_g").agg(F.min_by("start", "s").alias("start"), F.max("e").alias("end")).drop("_g")


def find_passive(df: DataFrame, threshold: float | None = 25.0, deviation: float | None = None, n_use: int | None = N_USE,
                 key: Sequence[str] = KEY, idx: str = "ping_index", window: int = 128, rows: int | None = None) -> DataFrame:
    """Passive stretches as half-open [start, end) index ranges.

    ``deviation`` sets the threshold to that many interquartile ranges of the steps.
    """
    near = cut(near_samples(df, n_use, key, idx))
    c = candidates(near.withColumnRenamed("x", "sv"), threshold, deviation, None, key, idx, rows)
    return _stretches(c, near, key, idx, 1, 0, window, rows)


def clusters(df: DataFrame, threshold_init: float | None = None, deviation: float | None = None, n_use: int | None = N_USE,
             sigma_depth: float = 0, sigma_time: float = 1, key: Sequence[str] = KEY, idx: str = "ping_index",
             rows: int | None = None) -> DataFrame:
    """Candidate starts and ends of the smoothed search.

    Steps beyond the threshold (12 by default) at most three pings apart form a cluster;
    its steepest step stands for it.
    """
    src = df.withColumn("sv", gaussian_depth("sv", sigma_depth)) if sigma_depth else df
    near = near_samples(src, n_use, key, idx)
    if sigma_time:
        near = gaussian_time(near, "x", sigma_time, is_array=True, key=key, idx=idx, rows=rows)
    md = cut(median_step(near, key, idx, rows=rows).drop("x"), "steps")
    if threshold_init is None and deviation is not None:
        q = quantiles(md, key, "step", [0.25, 0.75], rows=rows).select(
            *key, ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.35 * deviation).alias("thr")
        )
        md = md.join(q, list(key), "left")
    else:
        md = md.withColumn("thr", F.lit(12.0 if threshold_init is None else float(threshold_init)))
    parts = []
    for kind, over in (("is_start", F.col("step") < -F.col("thr")), ("is_end", F.col("step") > F.col("thr"))):
        r = numbered_runs(md.where(over).select(*key, idx, F.when(F.lit(kind == "is_start"), F.col("step")).otherwise(-F.col("step")).alias("_d")), key, idx, 3, rows)
        # The earliest of equally steep steps.
        r = r.groupBy(*key, "run").agg(F.min_by(idx, F.struct("_d", idx)).alias(idx)).drop("run")
        parts.append(r.withColumns({"is_start": F.lit(kind == "is_start"), "is_end": F.lit(kind == "is_end")}))
    return parts[0].unionByName(parts[1])


def find_passive_v2(df: DataFrame, threshold_inner: float | None = None, threshold_init: float | None = None,
                    deviation: float | None = None, n_use: int | None = N_USE, sigma_depth: float = 0, sigma_time: float = 1,
                    key: Sequence[str] = KEY, idx: str = "ping_index", window: int = 128, rows: int | None = None) -> DataFrame:
    """Passive stretches with smoothed candidates and a separate inner threshold (35 by default)."""
    if threshold_inner is not None and deviation is not None:
        raise ValueError("set only one of threshold_inner and deviation")
    near = cut(near_samples(df, n_use, key, idx))
    c = clusters(df, threshold_init, deviation, n_use, sigma_depth, sigma_time, key, idx, rows)
    if deviation is not None:
        src = df.withColumn("sv", gaussian_depth("sv", sigma_depth)) if sigma_depth else df
        md = cut(median_step(near_samples(src, n_use, key, idx), key, idx, rows=rows).drop("x"), "steps")
        q = quantiles(md, key, "step", [0.25, 0.75], rows=rows).select(
            *key, ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.35 * deviation).alias("thr")
        )
        c = c.join(q, list(key))
    else:
        c = c.withColumn("thr", F.lit(35.0 if threshold_inner is None else float(threshold_inner)))
    return _stretches(c, near, key, idx, 2, 1, window, rows)


def flag_ranges(df: DataFrame, ranges: DataFrame, out: str = "is_passive", key: Sequence[str] = KEY, idx: str = "ping_index",
                rows: int | None = None) -> DataFrame:
    """Pings inside half-open index ranges."""
    from .asof import flag_in_intervals  # noqa: PLC0415

    return flag_in_intervals(df.drop(out), ranges, list(key), idx, "start", "end", out, closed=False, rows=rows)


def compare_finders(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per recording: stretches found by both with equal bounds, and by one only."""
    ka = a.select(*key, "start", "end", F.lit(1).alias("_a"))
    kb = b.select(*key, "start", "end", F.lit(1).alias("_b"))
    j = ka.join(kb, [*key, "start", "end"], "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.groupBy(*key).agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_first_only"),
        F.count_if(F.col("_a").isNull()).alias("n_second_only"), F.bool_and(both).alias("agree"),
    )


# Known passive schedules, in pings. A rule applies where all its words occur
# in the lower-cased path; the first rule that applies counts. No period means that no
# ping is passive; rule "find" leaves the recording to the finder.
SCHEDULES = [
    # words, start, period, duration, action
    (("minaspassage", "december2017"), None, None, None, "none"),
    (("minaspassage", "march2018"), 0, 360, 60, "schedule"),
    (("minaspassage", "september2018"), 300, 360, 60, "schedule"),
    (("grandpassage", "phase1"), -200, 3420, 420, "schedule"),
]
# Recordings that do not follow their survey's schedule.
FIND_INSTEAD = [
    "D20181021-T165220_D20181021-T222221",
    "D20181022-T105220_D20181022-T162217",
    "D20181022-T172213_D20181022-T232217",
    "D20181026-T082220_D20181026-T135213",
    "D20181026-T142217_D20181026-T195218",
]
# Recordings of the second phase that follow the first phase's schedule.
LIKE_PHASE1 = [
    "WBAT_2B_20200125_UTC100017_floodhigh",
    "WBAT_2B_20200125_UTC160020_ebblow",
    "WBAT_2B_20200127_UTC000020_floodhigh",
    "WBAT_2B_20200127_UTC060020_ebblow",
    "WBAT_2B_20200127_UTC120021_floodhigh",
    "WBAT_2B_20200127_UTC180020_ebblow",
    "WBAT_2B_20200128_UTC000017_floodhigh",
    "WBAT_2B_20200128_UTC060017_ebblow",
    "WBAT_2B_20200128_UTC120023_floodhigh",
    "WBAT_2B_20200128_UTC180017_ebblow",
    "WBAT_2B_20200130_UTC080017_ebblow",
    "WBAT_2B_20200130_UTC140020_floodhigh",
    "WBAT_2B_20200130_UTC200017_ebblow",
    "WBAT_2B_20200131_UTC020020_floodhigh",
    "WBAT_2B_20200131_UTC080021_ebblow",
    "WBAT_2B_20200131_UTC140022_floodhigh",
    "WBAT_2B_20200202_UTC040019_floodhigh",
    "WBAT_2B_20200202_UTC100022_ebblow",
]


def schedule_flags(df: DataFrame, path: str = "path", idx: str = "ping_index", as_reference: bool = False) -> DataFrame:
    """Passive flag from the survey's known schedule, per ping.

    Adds ``schedule`` (``schedule``, ``none`` or ``find``) and ``is_passive``, NULL where
    the finder must decide. Row-local: the rules are constants, so nothing is joined. With
    ``as_reference`` the grand-passage schedule is left to the finder.
    """
    p = F.lower(path)
    parts = F.split(p, "[/\\\\]")

    def rule(words):
        c = F.array_contains(parts, words[0])
        for w in words[1:]:
            # The survey's phase is a folder; the others may be part of a name.
            c = c & (F.array_contains(parts, w) if w.startswith("phase") else p.contains(w))
        return c

    odd = F.lit(False)
    for name in FIND_INSTEAD:
        odd = odd | p.contains(name.lower())
    like1 = F.lit(False)
    for name in LIKE_PHASE1:
        like1 = like1 | p.contains(name.lower())
    grand = F.array_contains(parts, "grandpassage")
    cases = []
    for words, start, period, duration, action in SCHEDULES:
        cond = rule(words)
        if "september2018" in words:
            cases.append((cond & odd, (None, None, None, "find")))
        if "phase1" in words:
            cond = grand & F.when(F.array_contains(parts, "phase2"), like1).otherwise(F.array_contains(parts, "phase1"))
            if as_reference:
                action = "find"
        cases.append((cond, (start, period, duration, action)))
    fields = ("start", "period", "duration", "action")
    exprs = {}
    for i, f in enumerate(fields):
        e = None
        for cond, v in cases:
            val = F.lit(v[i]).cast("string" if f == "action" else "long")
            e = F.when(cond, val) if e is None else e.when(cond, val)
        exprs[f] = e
    i = F.col(idx)
    flag = (i >= exprs["start"]) & (F.pmod(i - exprs["start"], exprs["period"]) < exprs["duration"])
    act = F.coalesce(exprs["action"], F.lit("find"))
    return df.withColumn("schedule", act).withColumn(
        "is_passive", F.when(act == "schedule", flag).when(act == "none", F.lit(False))
    )
