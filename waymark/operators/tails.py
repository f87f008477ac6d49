"""Sparse tails: few samples far below or above the rest of an elevation run, replaced from what lies around them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from waymark import ship
from waymark.functions.rules import metres
from waymark.operators.continuity import Place, run_order, whole_run

# Fixed values.
#: Samples in a run from which tails are sought; metres that a seed lies beyond the reference rank; metres below which low seeds lie.
LEAST_SAMPLES, SEPARATION, LOW_SEED = 80, 20.0, 0.0
#: Ranks: reference and rim of low tails, the lowest tenth and the height up to which it lets low tails grow, reference and rim of high tails.
LOW_REFERENCE, LOW_RIM, LOW_TENTH, LOW_GROWS, HIGH_REFERENCE, HIGH_RIM = 0.15, 0.12, 0.1, 25.0, 0.85, 0.9
#: The most of a run's samples, way and time that a tail without support has.
SAMPLES, WAY, TIME = 0.05, 0.08, 0.08
#: The grade and the metres a second in height from which a step isn't plausible.
GRADE, CLIMB = 0.35, 1.2
#: Settling: seconds of the gap before, samples looked at, of these the stable ones and their range, metres in all and in the first step.
GAP_S, LOOKS, STABLE, TOLERANCE, SETTLES, FIRST_STEP = 1800.0, 6, 3, 2.5, 6.0, 2.0


KINDS = ("low", "high")


def with_seeds(run_points: DataFrame) -> DataFrame:
    """The runs with d, the way from the run's beginning; low_seed, low_rim, low_grows, high_seed, high_rim; has_seeds of the
    run: ranks are window aggregates, so nearly all runs are done with here."""
    ranks = (LOW_REFERENCE, LOW_RIM, LOW_TENTH, HIGH_REFERENCE, HIGH_RIM)
    rows = run_points.withColumn("d", F.sum(F.when(F.col("i") > 1, F.col("metres")).otherwise(0.0)).over(run_order().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_n": F.max("i").over(whole_run()), "_ranks": F.percentile("ele", F.array(*map(F.lit, ranks))).over(whole_run())})
    able, ele, at = F.col("_n") >= LEAST_SAMPLES, F.col("ele"), lambda p: F.col("_ranks")[ranks.index(p)]
    marks = {
        "low_grows": at(LOW_TENTH) <= LOW_GROWS, "low_seed": able & (ele < at(LOW_REFERENCE) - SEPARATION) & (ele < LOW_SEED), "low_rim": ele < at(LOW_RIM),
        "high_seed": able & (ele > at(HIGH_REFERENCE) + SEPARATION), "high_rim": ele > at(HIGH_RIM),
    }
    rows = rows.select(*run_points.columns, "d", *(v.alias(k) for k, v in marks.items()))
    return rows.withColumn("has_seeds", F.bool_or(F.col("low_seed") | F.col("high_seed")).over(whole_run()))


def islands(mark: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each stretch of true."""
    edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


@dataclass
class Run:
    """One run's samples in order; unknown times are NaN."""

    ele: np.ndarray
    d: np.ndarray
    s: np.ndarray
    lat: np.ndarray
    lon: np.ndarray

    def grown(self, seeds: list[tuple[int, int]], rim: np.ndarray) -> list[tuple[int, int]]:
        """Each island moved on through the samples within the rim that touch it."""
        place, n = np.arange(len(rim)), len(rim)
        before = np.maximum.accumulate(np.where(rim, -1, place))
        after = np.minimum.accumulate(np.where(rim, n, place)[::-1])[::-1]
        return [(int(before[a - 1]) + 1 if a else 0, int(after[b + 1]) - 1 if b + 1 < n else b) for a, b in seeds]

    def plausible(self, edge: int, anchor: int) -> bool:
        """The step from a run's edge to the sample beside its tail has a length or a time, and is neither too steep nor too fast."""
        rise, time = abs(self.ele[edge] - self.ele[anchor]), abs(self.s[edge] - self.s[anchor])
        way = metres(*(Place(self.lat[k], self.lon[k]) for k in (edge, anchor)))
        return (way > 0 or time > 0) and not (way > 0 and rise / way >= GRADE) and not (time > 0 and rise / time >= CLIMB)

    def unsupported(self, left: int, right: int) -> bool:
        """The samples from left to right are few, short in way and time, and no plausible beginning or end of their run."""
        last = len(self.ele) - 1
        way, time = self.d[last] - self.d[0], max(0.0, self.s[last] - self.s[0])
        taken = self.s[right] - self.s[left]
        if (right - left + 1) / (last + 1) > SAMPLES or way > 0 and max(0.0, self.d[right] - self.d[left]) / way > WAY or time > 0 and taken > 0 and taken / time > TIME:
            return False
        begins = left == 0 and right < last and self.plausible(left, right + 1)
        return not begins and not (right == last and left > 0 and self.plausible(right, left - 1))

    def settled(self, anchor: int, way: int, tail: np.ndarray) -> int | None:
        """Where the elevation settles behind an anchor across a long gap: the samples beyond it (up to a tail or the run's
        end) end in a stable stretch far from it, the first of them moves toward that, and the way there isn't plausible."""
        looks = range(anchor + way, anchor + way * (LOOKS + 1), way)
        looks = [k for k in looks if 0 <= k < len(tail)]
        looks = looks[: next((j for j, k in enumerate(looks) if tail[k]), len(looks))]
        if len(looks) < STABLE or not abs(self.s[anchor] - self.s[anchor - way]) >= GAP_S:
            return None
        heights = sorted(self.ele[looks[-STABLE:]])
        level, here = heights[(STABLE - 1) // 2], self.ele[anchor]
        whole, first = level - here, self.ele[looks[0]] - here
        if heights[-1] - heights[0] > TOLERANCE or np.sign(whole) != np.sign(first) or abs(first) < FIRST_STEP or abs(whole) < SETTLES:
            return None
        place = next(k for k in looks if abs(self.ele[k] - level) <= TOLERANCE)
        far, time = abs(self.d[place] - self.d[anchor]), abs(self.s[place] - self.s[anchor])
        return place if not far > 0 or abs(whole) / far > GRADE or time > 0 and abs(whole) / time > CLIMB else None

    def filled(self, tail: np.ndarray) -> np.ndarray:
        """New elevations, NaN where none: inside tails by way between what lies on either side, and at anchors that give way to
        where the elevation settles."""
        out = np.full(len(tail), np.nan)
        for a, b in islands(tail):
            sides = [k if 0 <= k < len(tail) else None for k in (a - 1, b + 1)]
            supports = []
            for anchor, way in zip(sides, (-1, 1), strict=True):
                place = None if anchor is None else self.settled(anchor, way, tail)
                if place is not None:
                    out[anchor] = self.ele[place]
                supports.append(anchor if place is None else place)
            p, q = supports
            inside = np.arange(a, b + 1)
            if p is None or q is None:
                out[inside] = self.ele[p if q is None else q]
                continue
            way = self.d[q] - self.d[p]
            share = (self.d[inside] - self.d[p]) / way if way > 0 else (inside - p) / (q - p)
            out[inside] = self.ele[p] + (self.ele[q] - self.ele[p]) * np.clip(share, 0, 1)
        return out


def tails_of(run: Run, marks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The samples of low and of high groups that have too little support to be kept."""
    low, high, cover = (np.zeros(len(run.ele), bool) for _ in range(3))
    seeds = islands(marks["low_seed"])
    for core, wide in zip(seeds, run.grown(seeds, marks["low_rim"]) if marks["low_grows"].any() else seeds, strict=True):
        for a, b in (wide, core):
            if run.unsupported(a, b):
                low[a : b + 1] = True
                break
    for a, b in run.grown(islands(marks["high_seed"]), marks["high_rim"]):
        cover[a : b + 1] = True
    for a, b in islands(cover):
        if (a == 0 or b == len(cover) - 1) and run.unsupported(a, b):
            high[a : b + 1] = True
    return {"low": low, "high": high}


def without_sparse_tails(run_points: DataFrame) -> DataFrame:
    """The runs with low_tail, high_tail and is_sparse_tail, and ele replaced where the last is true.

    Low groups are islands of seeds, each grown to the rim where the run's lowest tenth is low; if the grown group is kept, its
    seeds alone may still go. High groups are what all grown islands cover together, and go only at a run's ends. A group
    goes if it has few samples, little way and little time of its run, unless it is a plausible beginning or end. It is
    filled by way between the samples beside it (at an end, from the one). A sample beside a tail across half an hour, from
    which the elevation only settles, gives way to where it settles, both as a support and itself. In a tail of both kinds
    the high value counts.
    Runs without seeds, nearly all, are judged by windows alone. A task reads its runs one after another in batches, passes on
    batches without seeds as they are and holds one run, in time proportional to its length."""
    ship(run_points.sparkSession)
    kept, new = [*run_points.columns], ("low_tail", "high_tail", "is_sparse_tail")
    schema = StructType(list(run_points.schema.fields))
    for c in new:
        schema = schema.add(c, BooleanType())
    # the windows have brought each run together and in order
    rows = with_seeds(run_points).withColumn("begins", F.row_number().over(run_order()) == 1).sortWithinPartitions("track_id", "run", "i")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the run that goes on
        for batch in batches:
            starts = np.flatnonzero(batch.column("begins").to_numpy(zero_copy_only=False))
            if len(starts):
                yield from judged([*held, batch.slice(0, int(starts[-1]))], kept, new)
                held, batch = [], batch.slice(int(starts[-1]))
            held.append(batch)
        yield from judged(held, kept, new)

    return rows.mapInArrow(judge, schema)


def judged(batches: list[pa.RecordBatch], kept: list[str], new: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole runs, in order, with their tails filled and marked."""
    table = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if table is None or not table.num_rows:
        return
    low, high, filled = (np.zeros(table.num_rows, bool) for _ in new)
    out = table.select(kept)
    seeded = table.column("has_seeds").to_numpy()
    if seeded.any():
        number = lambda c: table.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy()
        ele, *others = number("ele"), number("d"), number("ts_ms") / 1000, number("lat"), number("lon")
        marks = {c: table.column(c).to_numpy() for c in (*(f"{k}_{x}" for k in KINDS for x in ("seed", "rim")), "low_grows")}
        values = ele.copy()
        bounds = [*np.flatnonzero(table.column("begins").to_numpy()).tolist(), table.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if not seeded[lo]:
                continue
            at = slice(lo, hi)
            run = Run(ele[at], *(x[at] for x in others))
            tails = tails_of(run, {c: x[at] for c, x in marks.items()})
            low[at], high[at] = tails["low"], tails["high"]
            for kind in KINDS:
                fill = run.filled(tails[kind])
                filled[at] |= ~np.isnan(fill)
                values[at] = np.where(np.isnan(fill), values[at], fill)
        out = out.set_column(kept.index("ele"), "ele", pc.if_else(pa.array(filled), pa.array(values), out.column("ele")))
    for name, mark in zip(new, (low, high, filled), strict=True):
        out = out.append_column(name, pa.array(mark))
    yield from out.combine_chunks().to_batches()
