"""The cleaning rules on rows of one track, for use inside tasks."""

from __future__ import annotations

import math

from waymark.functions.geo import ECC2, RADIUS

#: m/s that no pair may exceed, and the ceiling of slow tracks.
HARD_LIMIT, SLOW_CEILING = 50.0, 6.0


def metres(a, b) -> float:
    if a.lat == b.lat and a.lon == b.lon:
        return 0.0
    mean = math.radians((a.lat + b.lat) / 2)
    base = math.sqrt(1 - ECC2 * math.sin(mean) ** 2)
    return math.hypot(RADIUS * (1 - ECC2) / base**3 * math.radians(b.lat - a.lat), RADIUS / base * math.cos(mean) * math.radians(b.lon - a.lon))


def missing(x) -> bool:
    return x is None or x != x


def reason(last, p, after) -> str | None:
    """The first rule but the jump that drops p, after the point kept last and before the row ``after``; null if none does."""
    if missing(p.lat) or missing(p.lon) or not (-90 <= p.lat <= 90 and -180 <= p.lon <= 180):
        return "invalid_coordinates"
    if p.rejected:
        return "bad_fix"
    if last is None:
        return None
    timed = not (missing(p.ts_ms) or missing(last.ts_ms))
    same = p.segment == last.segment
    if after is not None and abs(p.lat) <= 1e-6 and abs(p.lon) <= 1e-6 and same and after.segment == p.segment and min(metres(last, p), metres(p, after)) > 100_000:
        return "null_island"
    if p.lat == last.lat and p.lon == last.lon and (p.ts_ms == last.ts_ms if timed else missing(p.ts_ms) and missing(last.ts_ms)):
        return "duplicate_points"
    if same and timed and p.ts_ms <= last.ts_ms:
        return "time_order"
    if after is not None and is_flip(last, p, after):
        return "heading_flip_jitter"
    return None


def is_flip(last, p, after) -> bool:
    """There and back: two legs of 5 to 10 m in up to 5 s each, ends 5 m apart at most, a turn of 120 degrees or more."""
    if missing(after.lat) or missing(after.lon) or not (-90 <= after.lat <= 90 and -180 <= after.lon <= 180) or not last.segment == p.segment == after.segment:
        return False
    if missing(last.ts_ms) or missing(p.ts_ms) or missing(after.ts_ms):
        return False
    near = 0 < p.ts_ms - last.ts_ms <= 5000 and 0 < after.ts_ms - p.ts_ms <= 5000 and 5 <= metres(last, p) <= 10 and 5 <= metres(p, after) <= 10
    return near and metres(last, after) <= 5 and turn(last, p, after) >= 120


def speed(a, b) -> float | None:
    """m/s from a to b within a segment; null without time between them."""
    if a.segment != b.segment or missing(a.ts_ms) or missing(b.ts_ms) or b.ts_ms <= a.ts_ms:
        return None
    return metres(a, b) / ((b.ts_ms - a.ts_ms) / 1000)


def bearing(a, b) -> float:
    p, q, d = math.radians(a.lat), math.radians(b.lat), math.radians(b.lon - a.lon)
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def turn(a, b, c) -> float:
    d = abs(bearing(a, b) - bearing(b, c))
    return min(d, 360 - d)


def corridors(points: list, ceiling: float) -> set[int]:
    """Places of points that are too fast for a slow track but part of a steady fast stretch: four pairs or more at 0.7 of
    the ceiling or above (one in between may have 0.5), three of them above it, up to 50 m/s, 0.35 direct or more, and no
    turn above 75 degrees. A pair next to a point that another rule drops isn't part of one."""
    known: dict[int, bool] = {}

    def doomed(k: int) -> bool:
        if k not in known:
            known[k] = reason(points[k - 1] if k else None, points[k], points[k + 1] if k + 1 < len(points) else None) is not None
        return known[k]

    pace = [None] * len(points)  # of pairs slow enough to end any stretch nothing is asked
    for k in range(1, len(points)):
        v = speed(points[k - 1], points[k])
        if v is not None and 0.5 * ceiling <= v <= HARD_LIMIT and not doomed(k) and not doomed(k - 1):
            pace[k] = v
    near = [v is not None and v >= 0.7 * ceiling for v in pace]
    found: set[int] = set()
    run: list[int] = []
    bridged = False
    for k in range(1, len(points) + 1):
        if k < len(points) and near[k]:
            run.append(k)
        elif k + 1 < len(points) and pace[k] is not None and pace[k] >= 0.5 * ceiling and near[k + 1] and run and not bridged:
            run.append(k)
            bridged = True
        else:
            fast = [j for j in run if pace[j] > ceiling]
            if len(run) >= 4 and len(fast) >= 3:
                way = sum(metres(points[j - 1], points[j]) for j in run)
                turns = [turn(points[j - 2], points[j - 1], points[j]) for j in run[1:]]
                if way > 0 and metres(points[run[0] - 1], points[run[-1]]) >= 0.35 * way and max(turns) <= 75:
                    found.update(fast)
            run, bridged = [], False
    return found


def reasons(points: list) -> list[str | None]:
    """The reason of each point; a dropped point is no neighbour of those after it. A speed above the ceiling drops a point
    last of all, unless the track is slow and the pair is part of a fast corridor."""
    out, last = [], None
    spared = corridors(points, points[0].ceiling_mps) if points and points[0].ceiling_mps == SLOW_CEILING and points[0].inferred else set()
    for k, p in enumerate(points):
        why = reason(last, p, points[k + 1] if k + 1 < len(points) else None)
        if why is None and last is not None:
            v = speed(last, p)
            if v is not None and v > p.ceiling_mps and not (k in spared and last is points[k - 1] and v <= HARD_LIMIT):
                why = "gps_jump"
        out.append(why)
        if why is None:
            last = p
    return out
