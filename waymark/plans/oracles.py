"""DuckDB SQL for the registered track queries, written apart from the DataFrame code."""

from __future__ import annotations


def dist(a: str, b: str) -> str:
    """Metres between the points with columns {a}lat, {a}lon and {b}lat, {b}lon."""
    m = f"radians(({a}lat + {b}lat) / 2)"
    base = f"sqrt(1 - 0.00669437999014 * sin({m}) * sin({m}))"
    north = f"(6378137.0 * (1 - 0.00669437999014) / ({base} * {base} * {base}) * radians({b}lat - {a}lat))"
    east = f"(6378137.0 / {base} * cos({m}) * radians({b}lon - {a}lon))"
    return f"(CASE WHEN {a}lat = {b}lat AND {a}lon = {b}lon THEN 0e0 ELSE sqrt({north} * {north} + {east} * {east}) END)"


SPARSE = """pts AS (SELECT user_id AS track_id, CAST(row_number() OVER w AS INT) AS seq, epoch_us(ts) // 1000 AS ts_ms,
    43 + event_id % 1000 * 1e-5 AS lat, 42 + event_id % 777 * 1e-5 AS lon, value AS ele,
    CAST((row_number() OVER w - 1) // 10 AS INT) AS segment, event_type, 'unknown' AS ele_source FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
DENSE = """base AS (SELECT user_id AS track_id, event_id AS e, value, row_number() OVER w AS seq, sum(1 + event_id % 4) OVER (w ROWS UNBOUNDED PRECEDING) AS run
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pts AS (SELECT track_id, CAST(seq AS INT) AS seq, CAST((run - CASE WHEN e % 53 = 0 THEN 1 + e % 4 ELSE 0 END) * 1000 AS BIGINT) AS ts_ms,
    43 + seq * 3e-5 + CASE WHEN e % 97 = 0 THEN 0.01e0 ELSE 0e0 END AS lat, 42 + e % 5 * 1e-6 AS lon,
    CASE WHEN e % 61 <> 0 THEN 100 + value / 50 + CASE WHEN e % 37 = 0 THEN 80e0 ELSE 0e0 END END AS ele, CAST((seq - 1) // 40 AS INT) AS segment,
    CASE WHEN e % 41 = 0 THEN 2 ELSE 9 END AS satellites, CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END AS ele_source FROM base)"""
SUPPLIER = """base AS (SELECT l_suppkey AS track_id, l_orderkey AS e, l_extendedprice AS price, row_number() OVER w AS seq, sum(2 + l_orderkey % 4) OVER (w ROWS UNBOUNDED PRECEDING) AS run
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)),
pts AS (SELECT track_id, CAST(seq AS INT) AS seq, CAST(run * 1000 AS BIGINT) AS ts_ms, 43 + seq * 4e-5 AS lat, 42 + e % 5 * 1e-6 AS lon, 100 + price / 2000 AS ele,
    CAST((seq - 1) // 500 AS INT) AS segment, 'unknown' AS ele_source FROM base)"""
JITTERED = DENSE.replace("43 + seq * 3e-5 + CASE WHEN e % 97 = 0 THEN 0.01e0 ELSE 0e0 END AS lat", "43 + floor(seq / 7) * 3e-5 + seq % 2 * 1e-6 AS lat")
PAIRS = f"""lagged AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(ts_ms) OVER w AS p_ts, lag(segment) OVER w AS p_seg, lag(seq) OVER w AS p_seq, lag(ele) OVER w AS p_ele,
    lag(ele_source) OVER w AS p_source FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
pairs AS (SELECT *, CASE WHEN p_seq IS NOT NULL THEN segment = p_seg END AS same_segment, CASE WHEN ts_ms < p_ts THEN 0e0 ELSE (ts_ms - p_ts) / 1000e0 END AS dt, {dist("p_", "")} AS metres FROM lagged)"""
GAPS = """medians AS (SELECT track_id, count(dt) FILTER (same_segment AND dt > 0) AS n_gaps, median(dt) FILTER (same_segment AND dt > 0) AS median_gap_s, max(dt) FILTER (same_segment AND dt > 0) AS longest_s FROM pairs GROUP BY track_id),
thresholds AS (SELECT *, CASE WHEN median_gap_s <= 10 THEN greatest(5 * median_gap_s, 30e0) WHEN median_gap_s > 10 THEN greatest(3 * median_gap_s, 120e0) END AS threshold_s FROM medians),
gapped AS (SELECT p.*, median_gap_s, threshold_s, coalesce(same_segment AND dt > threshold_s, false) AS is_gap FROM pairs p JOIN thresholds USING (track_id)),
bridged AS (SELECT *, coalesce(is_gap AND median_gap_s > 15 AND metres / dt * 3.6 BETWEEN 1.5 AND 180, false) AS is_bridge FROM gapped)"""
ROUTE = """route AS (SELECT *, CASE WHEN same_segment THEN metres ELSE 0e0 END AS route_m, CAST(sum(CASE WHEN same_segment THEN 0 WHEN same_segment IS NULL THEN 0 ELSE 1 END) OVER w AS INT) AS span,
    sum(CASE WHEN same_segment THEN metres ELSE 0e0 END) OVER w AS distance_m FROM bridged WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
SPEED = """speeds AS (SELECT track_id, seq, distance_m, route_m AS metres, dt, route_m / dt * 3.6 AS kmh FROM route WHERE same_segment AND dt > 0 AND (NOT is_gap OR is_bridge))"""
RELIABLE = """sorted AS (SELECT track_id, count(*) AS n, list_sort(list(kmh)) AS v, avg(CASE WHEN kmh > 6e0 * 3.6 THEN 1 ELSE 0 END) AS rejected_share FROM speeds GROUP BY track_id),
ranks AS (SELECT *, floor(v[CAST(floor((n - 1) * 0.1) AS INT) + 1] * 100 + 0.5) / 100 AS p10, floor(v[CAST(floor((n - 1) * 0.25) AS INT) + 1] * 100 + 0.5) / 100 AS p25, floor(list_median(v) * 100 + 0.5) / 100 AS p50 FROM sorted),
profiles AS (SELECT *, CASE WHEN n < 8 THEN 'unknown' WHEN p10 <= 5 AND p25 <= 8 AND p50 <= 24 AND rejected_share <= 0.5 THEN 'slow' WHEN p25 <= 15 AND p50 <= 30 THEN 'moderate' ELSE 'unknown' END AS profile FROM ranks),
ceilings AS (SELECT *, CASE profile WHEN 'slow' THEN 6e0 * 3.6 WHEN 'moderate' THEN 10e0 * 3.6 END AS ceiling_kmh FROM profiles),
reliable AS (SELECT s.* FROM speeds s JOIN ceilings c USING (track_id) WHERE ceiling_kmh IS NULL OR kmh <= ceiling_kmh)"""
#: Speeds of pairs with a way, changes between neighbours, and the activity that follows, from the CTE gapped.
ACTIVITY = """SELECT track_id, n_timed, round(a, 6) AS median_kmh, round(b, 6) AS p95_kmh, net_ele, raw_ele, descent_m, round(q, 6) AS directional,
    CASE reason WHEN 'no_timestamps' THEN 'route_plan' WHEN 'motor_speed' THEN 'motor' WHEN 'bike_speed' THEN 'bike' WHEN 'foot_speed' THEN 'foot' WHEN 'insufficient_motion_signal' THEN 'unknown' ELSE 'water' END AS activity,
    CASE reason WHEN 'no_timestamps' THEN 0.75e0 WHEN 'motor_speed' THEN 0.72e0 WHEN 'bike_speed' THEN 0.68e0 WHEN 'foot_speed' THEN 0.66e0 WHEN 'insufficient_motion_signal' THEN 0.35e0 WHEN 'noisy_sustained_descent' THEN 0.62e0 ELSE 0.7e0 END AS confidence, reason FROM
    (SELECT *, CASE WHEN n_timed < 2 THEN 'no_timestamps' WHEN sinks AND q >= 0.75 THEN 'sustained_directional_descent' WHEN sinks AND q < 0.75 AND raw_ele >= 4 * abs(net_ele) THEN 'noisy_sustained_descent'
        WHEN a >= 35 OR b >= 70 THEN 'motor_speed' WHEN a >= 8 OR b >= 18 THEN 'bike_speed' WHEN a > 0 THEN 'foot_speed' ELSE 'insufficient_motion_signal' END AS reason FROM
    (SELECT *, abs(net_ele) / nullif(raw_ele, 0) AS q, net_ele < -80 AND descent_m > 80 AND a <= 8 AND b <= 18 AS sinks FROM
    (SELECT track_id, count(ts_ms) AS n_timed, quantile_disc(kmh, 0.5) AS a, quantile_disc(kmh, 0.95) AS b, round(sum(step), 6) AS net_ele, round(sum(abs(step)), 6) AS raw_ele,
        CASE WHEN count(step) > 0 THEN round(coalesce(sum(-step) FILTER (step < 0 AND kmh IS NOT NULL), 0), 6) END AS descent_m FROM
    (SELECT *, CASE WHEN same_segment AND NOT (is_gap AND abs(ele - p_ele) >= 60) THEN ele - p_ele END AS step, CASE WHEN same_segment AND dt > 0 AND NOT is_gap AND metres > 0 THEN metres / dt * 3.6 END AS kmh FROM gapped)
    GROUP BY track_id)))"""
#: The motion profile: ranks floor((n - 1) p) of the speeds, shares above each ceiling, rounded before they are compared.
MOTION = """mv AS (SELECT track_id, metres / dt AS v FROM pairs WHERE same_segment AND dt > 0 AND metres / dt BETWEEN 0.3 AND 50),
ml AS (SELECT track_id, count(*) AS n, list_sort(list(v)) AS l, floor(count(*) FILTER (v > 6) / count(*) * 100 + 0.5) / 100 AS slow_share, floor(count(*) FILTER (v > 10) / count(*) * 100 + 0.5) / 100 AS moderate_share,
    floor(count(*) FILTER (v > 25) / count(*) * 100 + 0.5) / 100 AS fast_share FROM mv GROUP BY track_id),
mr AS (SELECT *, floor(l[CAST(floor((n - 1) * 0.5) AS INT) + 1] * 100 + 0.5) / 100 AS median_mps, floor(l[CAST(floor((n - 1) * 0.75) AS INT) + 1] * 100 + 0.5) / 100 AS p75_mps, floor(l[CAST(floor((n - 1) * 0.9) AS INT) + 1] * 100 + 0.5) / 100 AS p90_mps FROM ml),
motion AS (SELECT *, CASE WHEN n < 5 THEN 'unknown' WHEN median_mps <= 2.2 AND p75_mps <= 3.2 AND slow_share <= 0.25 THEN 'slow' WHEN median_mps <= 4.5 AND p75_mps <= 7.5 AND moderate_share <= 0.25 THEN 'moderate'
    WHEN median_mps <= 12 AND p75_mps <= 20 AND fast_share <= 0.25 THEN 'fast' ELSE 'unknown' END AS profile FROM mr),
ceil AS (SELECT track_id, CASE profile WHEN 'slow' THEN 6e0 WHEN 'moderate' THEN 10e0 WHEN 'fast' THEN 25e0 ELSE 50e0 END AS top FROM motion)"""
RUNS = """cuts AS (SELECT *, CASE WHEN coalesce(p_ele IS NULL OR NOT same_segment OR p_source <> ele_source OR (is_gap AND abs(ele - p_ele) >= 60), true) THEN 1 ELSE 0 END AS cut FROM gapped WHERE ele IS NOT NULL),
numbered AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM cuts),
runs AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id, run ORDER BY seq) AS INT) AS i FROM numbered)"""
TIMER = """bounds AS (SELECT track_id, min_by(ts_ms, seq) AS lo, max_by(ts_ms, seq) AS hi FROM pts GROUP BY track_id),
acts AS (SELECT track_id, seq, ts_ms, CASE event_type WHEN 'signup' THEN 'start' ELSE 'stop' END AS action FROM pts WHERE event_type IN ('signup', 'error')),
clamped AS (SELECT a.track_id, action, lo, hi, greatest(lo, least(hi, ts_ms)) AS t, row_number() OVER (PARTITION BY a.track_id ORDER BY ts_ms, seq) AS n FROM acts a JOIN bounds b ON a.track_id = b.track_id),
marks AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY track_id ORDER BY t, n) AS was FROM clamped) WHERE was IS NULL OR was <> action),
nexts AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, n) AS nxt FROM marks),
intervals AS (SELECT * FROM (SELECT track_id, t AS start_ms, coalesce(nxt, hi) AS end_ms FROM nexts WHERE action = 'start' UNION ALL SELECT track_id, lo, t FROM nexts WHERE action = 'stop' AND was IS NULL) WHERE end_ms > start_ms)"""
PLAIN = "samples AS (SELECT track_id, run, i, i * 15e0 AS d, ele, 1e0 AS sigma FROM runs)"
SIGMA = """steps AS (SELECT *, abs(ele - lag(ele) OVER (PARTITION BY track_id, run ORDER BY i)) AS step FROM runs),
near AS (SELECT *, list_sort(list_filter(list(step) OVER (PARTITION BY track_id, run ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), lambda x: x IS NOT NULL)) AS s FROM steps),
mids AS (SELECT *, s[(len(s) - 1) // 2 + 1] AS m FROM near),
sigmas AS (SELECT track_id, run, i, ele, coalesce(1.4826e0 * (list_sort(list_transform(s, lambda x: abs(x - m))))[(len(s) - 1) // 2 + 1], 0e0) AS sigma FROM mids)"""
BEAR = lambda a, b: f"fmod(degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon)))) + 360, 360)"
TURN = lambda a, b: f"(CASE WHEN abs({a} - {b}) > 180 THEN 360 - abs({a} - {b}) ELSE abs({a} - {b}) END)"


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def r(*columns: str) -> str:
    """Columns to six decimals, under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ROUTED = (PAIRS, GAPS, ROUTE)
RUNNING = (PAIRS, GAPS, RUNS)

ORACLE_SQL = {
    "pair_distance": sql(f"SELECT track_id, seq, same_segment, {r('dt', 'metres')} FROM pairs", SPARSE, PAIRS),
    "track_bounds": sql(
        f"SELECT track_id, {r('min_lat', 'max_lat', 'min_lon', 'max_lon')}, round(greatest({dist('n_', 's_')}, {dist('e_', 'w_')}), 6) AS span_m FROM c",
        SPARSE,
        "b AS (SELECT track_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM pts GROUP BY track_id)",
        """c AS (SELECT *, min_lat AS n_lat, max_lat AS s_lat, (min_lon + max_lon) / 2 AS n_lon, (min_lon + max_lon) / 2 AS s_lon,
            (min_lat + max_lat) / 2 AS e_lat, (min_lat + max_lat) / 2 AS w_lat, min_lon AS e_lon, max_lon AS w_lon FROM b)""",
    ),
    "time_gaps": sql(f"SELECT track_id, n_gaps, {r('median_gap_s', 'threshold_s')} FROM thresholds", SPARSE, PAIRS, GAPS),
    "time_gap_breaks": sql(f"SELECT track_id, seq, {r('dt', 'threshold_s')}, is_bridge FROM bridged WHERE is_gap", SPARSE, PAIRS, GAPS),
    "continuous_segments": sql(
        "SELECT track_id, cont_segment, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_points, round((max(ts_ms) - min(ts_ms)) / 1000e0, 6) AS duration_s FROM s GROUP BY ALL",
        SPARSE, PAIRS, GAPS,
        "s AS (SELECT *, CAST(sum(CASE WHEN same_segment = false OR is_gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS INT) AS cont_segment FROM gapped)",
    ),
    "elapsed_duration": sql(
        "SELECT track_id, round(sum(ms) / 1000e0, 6) AS total_s, count(*) > 1 AS has_breaks FROM s GROUP BY track_id",
        SPARSE, "s AS (SELECT track_id, segment, max(ts_ms) - min(ts_ms) AS ms FROM pts GROUP BY ALL)",
    ),
    "recording_mode": sql(
        f"""SELECT track_id, n_points, n_timed, n_intervals, {r('nominal_s', 'longest_s')}, CASE WHEN nominal_s > 60 THEN 'sampling_sparse' WHEN nominal_s > 15 THEN 'sampling_smart_recording' END AS flag, CASE WHEN nominal_s IS NULL THEN 'untimed' WHEN nominal_s <= 2 THEN 'dense' WHEN nominal_s <= 15 THEN 'regular'
            WHEN nominal_s <= 60 THEN 'smart' ELSE 'sparse' END AS mode FROM (SELECT track_id, count(*) AS n_points, count(ts_ms) AS n_timed, count(*) FILTER (same_segment AND dt > 0) AS n_intervals, median(dt) FILTER (same_segment AND dt > 0) AS nominal_s, max(dt) FILTER (same_segment AND dt > 0) AS longest_s FROM pairs GROUP BY track_id)""",
        DENSE, PAIRS,
    ),
    "distance_series": sql(f"SELECT track_id, seq, span, {r('distance_m')} FROM route", SPARSE, *ROUTED),
    "distance_3d": sql(
        "SELECT track_id, round(sum(route_m), 6) AS distance_2d_m, round(sum(sqrt(route_m * route_m + (ele - p_ele) * (ele - p_ele))) FILTER (same_segment), 6) AS distance_3d_m FROM route GROUP BY track_id",
        SPARSE, *ROUTED,
    ),
    "percentile_flavours": sql(
        "SELECT track_id, "
        + ", ".join(
            x
            for p in (10, 50, 95)
            for x in (
                f"round(v[greatest(1, CAST(ceil(n * {p / 100}) AS INT))], 6) AS nearest_{p}", f"round(quantile_cont_{p}, 6) AS interpolated_{p}",
                f"round(v[CAST(floor((n - 1) * {p / 100}) AS INT) + 1], 6) AS lower_{p}", f"round(v[CAST(ceil((n - 1) * {p / 100}) AS INT) + 1], 6) AS upper_{p}",
            )
        )
        + ", round(med, 6) AS median FROM s",
        SPARSE,
        "s AS (SELECT track_id, count(*) AS n, list_sort(list(ele)) AS v, median(ele) AS med, " + ", ".join(f"quantile_cont(ele, {p / 100}) AS quantile_cont_{p}" for p in (10, 50, 95)) + " FROM pts GROUP BY track_id)",
    ),
    "fix_quality": sql(
        "SELECT track_id, seq, satellites, fix, hdop, vdop, pdop, satellites < 3 OR pdop > 6 OR hdop > 8 OR vdop > 8 OR lower(trim(fix)) IN ('none', 'unknown') AS rejected, satellites < 4 OR hdop > 5 AS warned FROM q",
        DENSE, "q AS (SELECT *, CASE seq % 13 WHEN 0 THEN ' None' WHEN 5 THEN 'unknown' ELSE '3d' END AS fix, CAST(seq % 10 AS DOUBLE) AS hdop, CAST(seq * 3 % 11 AS DOUBLE) AS vdop, CAST(seq * 5 % 8 AS DOUBLE) AS pdop FROM pts)",
    ),
    "time_order": sql(
        "SELECT track_id, seq, ts_ms FROM (SELECT *, max(ts_ms) OVER (PARTITION BY track_id, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pts) WHERE m IS NULL OR ts_ms > m", DENSE
    ),
    "duplicate_points": sql(
        """SELECT track_id, seq, t AS ts_ms, la AS lat FROM (SELECT *, lag(t) OVER w AS pt, lag(la) OVER w AS pla FROM q WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE pt IS NULL OR NOT (pt = t AND pla = la)""",
        DENSE, "q AS (SELECT track_id, seq, ts_ms // 6000 AS t, CAST(seq // 3 AS DOUBLE) AS la FROM pts)",
    ),
    "motion_profile": sql(
        f"SELECT m.track_id, n, {r('median_mps', 'p75_mps', 'p90_mps', 'slow_share', 'moderate_share', 'fast_share')}, profile, CASE WHEN profile = 'unknown' THEN 'default' ELSE 'inferred' END AS profile_source, CASE WHEN profile = 'unknown' THEN 'low' ELSE 'high' END AS confidence, top AS ceiling_mps FROM motion m JOIN ceil c ON m.track_id = c.track_id", DENSE, PAIRS, MOTION
    ),
    "turn_angles": sql(
        f"SELECT track_id, seq, round({TURN('b', 'nb')}, 6) AS turn_deg FROM q WHERE b IS NOT NULL AND nb IS NOT NULL",
        SPARSE, PAIRS,
        f"q AS (SELECT track_id, seq, {BEAR('p_', '')} AS b, lead({BEAR('p_', '')}) OVER (PARTITION BY track_id ORDER BY seq) AS nb FROM pairs)",
    ),
    "raw_speed": sql(f"SELECT track_id, seq, {r('distance_m', 'metres', 'dt', 'kmh')} FROM speeds", DENSE, *ROUTED, SPEED),
    "speed_reliability": sql(f"""SELECT track_id, n, {r('p10', 'p25', 'p50', 'rejected_share')}, profile, CASE WHEN profile = 'unknown' THEN 'default' ELSE 'speed_distribution' END AS profile_source, {r('ceiling_kmh')}, (SELECT count(*) FROM speeds s WHERE s.track_id = ceilings.track_id AND kmh > ceiling_kmh) AS n_outliers,
        CASE WHEN n >= 8 AND p10 <= 5 AND p25 <= 8 AND p50 <= 24 AND rejected_share > 0.5 THEN 'slow_rejected_share_too_high' END AS warning FROM ceilings""", DENSE, *ROUTED, SPEED, RELIABLE),
    "speed_smoothing": sql(
        "SELECT track_id, seq, round(kmh, 6) AS kmh, round(avg(kmh) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth_kmh FROM reliable", DENSE, *ROUTED, SPEED, RELIABLE
    ),
    "max_speed": sql("SELECT track_id, round(max(kmh), 6) AS max_kmh, count(*) AS n FROM reliable GROUP BY track_id", DENSE, *ROUTED, SPEED, RELIABLE),
    "slope_asof": sql(
        """SELECT track_id, seq, round(CASE WHEN ele IS NULL OR b.e IS NULL THEN NULL WHEN distance_m - b.d <= 0 THEN 0e0 ELSE (ele - b.e) / (distance_m - b.d) * 100 END, 6) AS slope_pct FROM q WHERE seq > 1""",
        SPARSE, *ROUTED,
        """q AS (SELECT track_id, seq, ele, distance_m, coalesce((SELECT max({'s': x.seq, 'e': x.ele, 'd': x.distance_m}) FROM route x WHERE x.track_id = a.track_id AND x.span = a.span AND x.distance_m <= a.distance_m - 100),
            (SELECT min({'s': x.seq, 'e': x.ele, 'd': x.distance_m}) FROM route x WHERE x.track_id = a.track_id AND x.span = a.span)) AS b FROM route a)""",
    ),
    "splits_5km": sql(
        "SELECT track_id, split, round(sum(metres * share), 6) AS metres, round(sum(dt * share), 6) AS seconds, round(sum(metres * share) / sum(dt * share) * 3.6, 6) AS kmh FROM parts WHERE share > 0 GROUP BY track_id, split",
        SUPPLIER, *ROUTED, SPEED,
        """parts AS (SELECT s.*, k AS split, (least(distance_m, (k + 1) * 5000e0) - greatest(distance_m - metres, k * 5000e0)) / metres AS share FROM (SELECT * FROM speeds WHERE metres > 0) s, (SELECT unnest(range(0, 2000)) AS k) g
            WHERE distance_m - metres < (k + 1) * 5000e0 AND distance_m > k * 5000e0)""",
    ),
    "nearest_sample": sql(
        """SELECT track_id, at_m, round(d, 6) AS distance_m FROM (SELECT t.track_id, at_m, min_by(distance_m, {'a': abs(distance_m - at_m), 'd': distance_m}) AS d FROM route t, (SELECT unnest([0e0, 25e0, 51.5e0, 90e0, 10000e0]) AS at_m) q GROUP BY t.track_id, at_m)""",
        DENSE, *ROUTED,
    ),
    "timer_intervals": sql("SELECT * FROM intervals", SPARSE, TIMER),
    "interval_clip": sql(
        "SELECT i.track_id, greatest(start_ms, lo_ms) AS start_ms, least(end_ms, hi_ms) AS end_ms FROM intervals i JOIN g ON i.track_id = g.track_id AND start_ms < hi_ms AND lo_ms < end_ms",
        SPARSE, TIMER, "g AS (SELECT track_id, segment, min(ts_ms) AS lo_ms, max(ts_ms) AS hi_ms FROM pts GROUP BY ALL)",
    ),
    "distance_in_intervals": sql(
        """SELECT p.track_id, round(sum(metres * (least(ts_ms, end_ms) - greatest(p_ts, start_ms)) / (ts_ms - p_ts)), 6) AS metres, round(sum(least(ts_ms, end_ms) - greatest(p_ts, start_ms)) / 1000e0, 6) AS seconds
            FROM pairs p JOIN intervals i ON p.track_id = i.track_id AND p_ts < end_ms AND start_ms < ts_ms WHERE same_segment AND dt > 0 GROUP BY p.track_id""",
        SPARSE, PAIRS, TIMER,
    ),
    "moving_hysteresis": sql(
        "SELECT track_id, round(CASE WHEN mv > 0 THEN mv END, 6) AS moving_s, round(CASE WHEN mv > 0 THEN mvm END, 6) AS moving_m FROM f WHERE k = n",
        DENSE, *ROUTED, SPEED,
        "o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM speeds)",
        """f AS (SELECT track_id, CAST(0 AS BIGINT) AS k, n, false AS mov, 0e0 AS mv, 0e0 AS mvm, 0e0 AS ps, 0e0 AS psm, 0e0 AS pm, 0e0 AS pmm FROM o WHERE k = 1
            UNION ALL SELECT o.track_id, o.k, o.n,
              CASE WHEN mov THEN NOT (kmh <= 1.5 AND ps + dt >= 10) ELSE kmh >= 3 AND pm + dt >= 5 END,
              CASE WHEN mov AND kmh > 1.5 THEN mv + ps + dt WHEN NOT mov AND kmh >= 3 AND pm + dt >= 5 THEN mv + pm + dt ELSE mv END,
              CASE WHEN mov AND kmh > 1.5 THEN mvm + psm + metres WHEN NOT mov AND kmh >= 3 AND pm + dt >= 5 THEN mvm + pmm + metres ELSE mvm END,
              CASE WHEN mov AND kmh <= 1.5 AND ps + dt < 10 THEN ps + dt ELSE 0 END, CASE WHEN mov AND kmh <= 1.5 AND ps + dt < 10 THEN psm + metres ELSE 0 END,
              CASE WHEN NOT mov AND kmh >= 3 AND pm + dt < 5 THEN pm + dt ELSE 0 END, CASE WHEN NOT mov AND kmh >= 3 AND pm + dt < 5 THEN pmm + metres ELSE 0 END
            FROM f JOIN o ON o.track_id = f.track_id AND o.k = f.k + 1)""",
        recursive=True,
    ),
    "elevation_runs": sql("SELECT track_id, seq, run, i, ele_source FROM runs", DENSE, *RUNNING),
    "raw_extrema": sql("SELECT track_id, round(min(ele), 6) AS min_ele, round(max(ele), 6) AS max_ele, count(ele) AS n_ele FROM pts GROUP BY track_id", DENSE),
    "hampel_outliers": sql(
        """SELECT track_id, run, i, round(ele, 6) AS ele, round(CASE WHEN i > 1 AND i < n AND (CASE WHEN sg > 0 THEN abs(ele - m) > greatest(fl, 3 * sg) ELSE abs(ele - m) > fl AND abs(ele - lf) > fl AND abs(ele - rt) > fl END) THEN (lf + rt) / 2 ELSE ele END, 6) AS clean FROM z""",
        SPARSE, *RUNNING,
        """x AS (SELECT *, list_sort(list(ele) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS s, lag(ele) OVER w AS lf, lead(ele) OVER w AS rt, count(*) OVER (PARTITION BY track_id, run) AS n,
            least(12e0, greatest(4e0, 0.15 * (max(ele) OVER (PARTITION BY track_id, run) - min(ele) OVER (PARTITION BY track_id, run)))) AS fl FROM runs WINDOW w AS (PARTITION BY track_id, run ORDER BY i))""",
        "y AS (SELECT *, s[(len(s) - 1) // 2 + 1] AS m FROM x)",
        "z AS (SELECT *, 1.4826e0 * (list_sort(list_transform(s, lambda q: abs(q - m))))[(len(s) - 1) // 2 + 1] AS sg FROM y)",
    ),
    "smooth_runs": sql(
        """SELECT track_id, run, i, round(ele, 6) AS ele, round(CASE WHEN i = 1 OR i = count(*) OVER (PARTITION BY track_id, run) THEN ele ELSE avg(ele) OVER (PARTITION BY track_id, run ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth FROM runs""",
        SPARSE, *RUNNING,
    ),
    "local_sigma": sql(f"SELECT track_id, run, i, {r('ele', 'sigma')} FROM sigmas", SPARSE, *RUNNING, SIGMA),
    "selected_thresholds": sql(
        "SELECT track_id, round(v[CAST(ceil((len(v) - 1) * 0.5) AS INT) + 1], 6) AS median_m, round(v[CAST(ceil((len(v) - 1) * 0.95) AS INT) + 1], 6) AS p95_m FROM (SELECT track_id, list_sort(list(greatest(5e0, sigma * 3))) AS v FROM sigmas GROUP BY track_id)",
        SPARSE, *RUNNING, SIGMA,
    ),
    "gain_loss": sql(
        """SELECT track_id, run, round(gain + CASE WHEN dir <> 0 THEN greatest(e - last, 0) ELSE 0 END, 6) AS gain_m, round(loss + CASE WHEN dir <> 0 THEN greatest(last - e, 0) ELSE 0 END, 6) AS loss_m FROM f WHERE i = n""",
        DENSE.replace("CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END", "'unknown'"), *RUNNING, PLAIN,
        "o AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n FROM samples)",
        """f AS (SELECT track_id, run, 1 AS i, n, 0 AS dir, d, ele AS e, ele AS last, 0e0 AS gain, 0e0 AS loss FROM o WHERE i = 1
            UNION ALL SELECT o.track_id, o.run, o.i, o.n,
              CASE WHEN dir = 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20 THEN CAST(sign(ele - e) AS INT) WHEN dir <> 0 AND (ele - e) * dir < 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20 THEN -dir ELSE dir END,
              CASE WHEN (dir = 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20) OR (dir <> 0 AND (ele - e) * dir >= 0) OR (dir <> 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20) THEN o.d ELSE f.d END,
              CASE WHEN (dir = 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20) OR (dir <> 0 AND (ele - e) * dir >= 0) OR (dir <> 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20) THEN ele ELSE e END,
              CASE WHEN dir <> 0 AND (ele - e) * dir < 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20 THEN e ELSE last END,
              gain + CASE WHEN dir <> 0 AND (ele - e) * dir < 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20 THEN greatest(e - last, 0) ELSE 0 END,
              loss + CASE WHEN dir <> 0 AND (ele - e) * dir < 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20 THEN greatest(last - e, 0) ELSE 0 END
            FROM f JOIN o ON o.track_id = f.track_id AND o.run = f.run AND o.i = f.i + 1)""",
        recursive=True,
    ),
    "robust_envelope": sql(
        """SELECT track_id, round(min(sane), 6) AS min_ele, round(max(sane), 6) AS max_ele FROM (SELECT track_id, CASE WHEN abs(ele - (l + h) / 2) > greatest(12e0, 3 * abs(h - l)) THEN (l + h) / 2 ELSE ele END AS sane FROM
            (SELECT *, lag(ele) OVER w AS l, lead(ele) OVER w AS h FROM runs WINDOW w AS (PARTITION BY track_id, run ORDER BY i))) GROUP BY track_id""",
        DENSE, *RUNNING,
    ),
    "net_change": sql(
        "SELECT track_id, round(sum(net), 6) AS net_m FROM (SELECT track_id, run, max_by(ele, i) - min_by(ele, i) AS net FROM samples GROUP BY ALL) GROUP BY track_id",
        DENSE.replace("CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END", "'unknown'"), *RUNNING, PLAIN,
    ),
    "activity_features": sql(ACTIVITY, DENSE, PAIRS, GAPS),
    "resample_grid": sql(
        """SELECT track_id, run, CAST(row_number() OVER (PARTITION BY track_id, run ORDER BY d) AS INT) AS i, round(d, 6) AS d, round(ele, 6) AS ele FROM
            (SELECT track_id, run, k * 10e0 AS d, e0 + (ele - e0) * (k * 10e0 - d0) / (d - d0) AS ele FROM h, (SELECT unnest(range(0, 2000)) AS k) WHERE d > d0 AND k * 10e0 >= d0 AND k * 10e0 < d
             UNION ALL SELECT track_id, run, d, ele FROM h WHERE i = n)""",
        DENSE, *RUNNING,
        "g AS (SELECT *, sum(CASE WHEN i > 1 THEN metres ELSE 0e0 END) OVER (PARTITION BY track_id, run ORDER BY i ROWS UNBOUNDED PRECEDING) AS d, count(*) OVER (PARTITION BY track_id, run) AS n FROM runs)",
        "h AS (SELECT *, lag(d) OVER (PARTITION BY track_id, run ORDER BY i) AS d0, lag(ele) OVER (PARTITION BY track_id, run ORDER BY i) AS e0 FROM g)",
    ),
    "colour_scale": sql(
        "SELECT track_id, round(a, 6) AS low_kmh, round(b, 6) AS high_kmh FROM (SELECT track_id, quantile_cont(kmh, 0.1) AS a, quantile_cont(kmh, 0.9) AS b, count(*) AS n FROM reliable GROUP BY track_id) WHERE n >= 2 AND b - a >= 0.1",
        DENSE, *ROUTED, SPEED, RELIABLE,
    ),
    "chart_rows": sql(
        """SELECT track_id, run, i, round(d / 1000, 6) AS km, round(ele, 6) AS ele FROM samples UNION ALL SELECT track_id, run, i, NULL, NULL FROM samples WHERE i = 1 AND run > (SELECT min(run) FROM samples s WHERE s.track_id = samples.track_id)""",
        DENSE.replace("CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END", "'unknown'"), *RUNNING, PLAIN,
    ),
    "viewport": sql(
        """SELECT track_id, seq, round(40 + coalesce((lon - a) / nullif(b - a, 0), 0.5) * 640, 6) AS x, round(430 - 40 - coalesce((lat - c) / nullif(d - c, 0), 0.5) * 350, 6) AS y FROM
            (SELECT *, min(lon) OVER w AS a, max(lon) OVER w AS b, min(lat) OVER w AS c, max(lat) OVER w AS d FROM pts WINDOW w AS (PARTITION BY track_id))""",
        SPARSE,
    ),
    "geojson_lines": sql(
        "SELECT track_id, 'LineString' AS type, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS INT) AS k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM pts) WHERE n >= 2", SPARSE
    ),
    "number_parsing": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 6) END AS value FROM orders",
    "formatters": """SELECT o_orderkey, coalesce(printf('%d:%02d:%02d', v // 3600, v % 3600 // 60, v % 60), '—') AS clock, coalesce(format('{:,}', (v + 50) // 1000) || printf('.%d km', (v + 50) // 100 % 10), '—') AS kilometres,
        coalesce(format('{:,}.0 km/h', v), '—') AS speed_text, coalesce(format('{:,}.0 m', v), '—') AS metres_text,
        coalesce(printf('%d m', v), 'n/a') AS rounded_metres, coalesce(printf('%d s', v), 'n/a') AS rounded_seconds, coalesce(printf('%d', v), '0') AS rounded_count FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders)""",
    "time_parsing": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t + 250 - 7200000 WHEN 3 THEN t + 5400000 END AS ts_ms,
        CASE o_orderkey % 7 WHEN 1 THEN 'missing' WHEN 4 THEN 'invalid' WHEN 5 THEN 'none' WHEN 6 THEN 'none' ELSE 'explicit' END AS zone FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 * 1000 AS t FROM orders)""",
    "period_label": sql(
        """SELECT track_id, coalesce(CASE WHEN a = b THEN monthname(a) || strftime(a, ' %-d, %Y') WHEN ym THEN monthname(b) || strftime(a, ' %-d-') || strftime(b, '%-d, %Y')
            WHEN yy THEN monthname(a) || strftime(a, ' %-d - ') || monthname(b) || strftime(b, ' %-d, %Y') ELSE monthname(a) || strftime(a, ' %-d, %Y - ') || monthname(b) || strftime(b, ' %-d, %Y') END, '') AS label,
            coalesce(CASE WHEN a = b THEN strftime(a, '%-d de ') || ma || strftime(a, ' de %Y') WHEN ym THEN strftime(a, '%-d-') || strftime(b, '%-d de ') || mb || strftime(b, ' de %Y')
            WHEN yy THEN strftime(a, '%-d de ') || ma || strftime(b, ' - %-d de ') || mb || strftime(b, ' de %Y') ELSE strftime(a, '%-d de ') || ma || strftime(a, ' de %Y - ') || strftime(b, '%-d de ') || mb || strftime(b, ' de %Y') END, '') AS label_es FROM (
            SELECT *, year(a) = year(b) AS yy, year(a) = year(b) AND month(a) = month(b) AS ym, es[month(a)] AS ma, es[month(b)] AS mb FROM (SELECT track_id, CAST(epoch_ms(min(t)) AS DATE) AS a, CAST(epoch_ms(max(t)) AS DATE) AS b,
            ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'] AS es FROM q GROUP BY track_id))""",
        SPARSE,
        "q AS (SELECT track_id, CASE WHEN track_id % 4 <> 3 OR track_id % 8 = 7 THEN ts_ms END AS t FROM pts WHERE track_id % 4 IN (0, 3) OR (track_id % 4 = 1 AND seq <= 3) OR (track_id % 4 = 2 AND seq <= 1))",
    ),
    "formatter_languages": """SELECT o_orderkey, en || ' m' AS en, translate(en, ',.', '.,') || ' m' AS de, CASE WHEN v < 100000 THEN printf('%d,%d', v // 10, v % 10) ELSE translate(en, ',.', '.,') END || ' m' AS es, translate(en, ',.', ' ,') || ' m' AS fr, translate(en, ',.', ' ,') || ' m' AS ru
        FROM (SELECT o_orderkey, v, format('{:,}', v // 10) || printf('.%d', v % 10) AS en FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (1 + o_orderkey % 40)) AS BIGINT) AS v FROM orders))""",
    "analysis_modes": """SELECT DISTINCT user_id AS track_id, 'recomputed_filtered,recomputed_raw' || CASE WHEN user_id % 3 = 0 THEN ',recomputed_terrain' ELSE '' END || CASE WHEN user_id % 2 = 0 THEN ',imported_summary' ELSE '' END AS modes,
        CASE WHEN user_id % 3 = 0 THEN 'recomputed_terrain' ELSE 'recomputed_filtered' END AS default_mode FROM events""",
}

SUMMARY = """SELECT track_id, n_points, round(m, 6) AS total_distance_m, round(s, 6) AS total_s, round(nominal_s, 6) AS nominal_s,
    CASE WHEN nominal_s IS NULL THEN 'untimed' WHEN nominal_s <= 2 THEN 'dense' WHEN nominal_s <= 15 THEN 'regular' WHEN nominal_s <= 60 THEN 'smart' ELSE 'sparse' END AS mode,
    round(max_kmh, 6) AS max_kmh, round(CASE WHEN s > 0 THEN m / s * 3.6 END, 6) AS average_kmh FROM a JOIN b USING (track_id) JOIN c USING (track_id) LEFT JOIN d USING (track_id)"""
for _name, _points in (("track_summary", SPARSE), ("supplier_track_summary", SUPPLIER)):
    ORACLE_SQL[_name] = sql(
        SUMMARY, _points, *ROUTED, SPEED, RELIABLE,
        "a AS (SELECT track_id, count(*) AS n_points, sum(route_m) AS m FROM route GROUP BY track_id)",
        "b AS (SELECT track_id, sum(ms) / 1000e0 AS s FROM (SELECT track_id, segment, max(ts_ms) - min(ts_ms) AS ms FROM pts GROUP BY ALL) GROUP BY track_id)",
        "c AS (SELECT track_id, median_gap_s AS nominal_s FROM medians)", "d AS (SELECT track_id, max(kmh) AS max_kmh FROM reliable GROUP BY track_id)",
    )

#: The cleaning rules that the dense points' faults can trip, folded over rows: the last kept row travels along.
ORACLE_SQL["cleaned_points"] = sql(
    "SELECT track_id, seq, reason FROM f",
    DENSE, PAIRS,
    MOTION,
    "o AS (SELECT p.*, coalesce(top, 50e0) AS top FROM pts p LEFT JOIN ceil c ON p.track_id = c.track_id)",
    f"""f AS (SELECT track_id, seq, CASE WHEN satellites < 3 THEN 'bad_fix' END AS reason, CASE WHEN satellites >= 3 THEN lat END AS k_lat, CASE WHEN satellites >= 3 THEN lon END AS k_lon,
            CASE WHEN satellites >= 3 THEN ts_ms END AS k_ts, CASE WHEN satellites >= 3 THEN segment END AS k_seg FROM o WHERE seq = 1
        UNION ALL SELECT track_id, seq, reason, CASE WHEN reason IS NULL THEN lat ELSE k_lat END, CASE WHEN reason IS NULL THEN lon ELSE k_lon END, CASE WHEN reason IS NULL THEN ts_ms ELSE k_ts END,
            CASE WHEN reason IS NULL THEN segment ELSE k_seg END FROM
            (SELECT o.track_id, o.seq, o.lat, o.lon, o.ts_ms, o.segment, f.k_lat, f.k_lon, f.k_ts, f.k_seg, CASE WHEN satellites < 3 THEN 'bad_fix' WHEN k_ts IS NULL THEN NULL
                WHEN o.lat = k_lat AND o.lon = k_lon AND o.ts_ms = k_ts THEN 'duplicate_points' WHEN o.segment = k_seg AND o.ts_ms <= k_ts THEN 'time_order'
                WHEN o.segment = k_seg AND {dist("k_", "o.")} / ((o.ts_ms - k_ts) / 1000e0) > top THEN 'gps_jump' END AS reason FROM f JOIN o ON o.track_id = f.track_id AND o.seq = f.seq + 1))""",
    recursive=True,
)
ORACLE_SQL["xy_jitter"] = sql(
    "SELECT track_id, seq, round(metres, 6) AS metres FROM f WHERE shakes",
    JITTERED, PAIRS, GAPS,
    f"""f AS (SELECT track_id, seq, metres, false AS shakes, lat AS a_lat, lon AS a_lon FROM gapped WHERE seq = 1
        UNION ALL SELECT track_id, seq, metres, shakes, CASE WHEN shakes THEN a_lat ELSE lat END, CASE WHEN shakes THEN a_lon ELSE lon END FROM
            (SELECT g.track_id, g.seq, g.metres, g.lat, g.lon, f.a_lat, f.a_lon, coalesce(g.same_segment AND NOT g.is_gap AND g.dt > 0 AND g.metres > 0 AND g.metres / g.dt * 3.6 <= 0.9 AND {dist("a_", "g.")} <= 5, false) AS shakes
                FROM f JOIN gapped g ON g.track_id = f.track_id AND g.seq = f.seq + 1))""",
    recursive=True,
)
ORACLE_SQL["source_trust"] = sql(
    """SELECT p.track_id, p.ele_source, n_pairs, round(p75_delta, 6) AS p75_delta, round(p95_delta, 6) AS p95_delta, round(median_m, 6) AS median_m, round(p95_grade, 6) AS p95_grade, round(p95_vertical_mps, 6) AS p95_vertical_mps,
        drifts, spikes, round(ratio, 6) AS change_ratio, noisy,
        CASE WHEN n_pairs < 1 THEN 0 WHEN p.ele_source = 'barometric' THEN CASE WHEN noisy OR drifts OR coalesce(rng > 0 AND rng <= 1 AND ratio >= 8, false) THEN 0.35e0 ELSE 0.55e0 END WHEN noisy THEN 0.35e0 ELSE 0.55e0 END AS abs_trust,
        CASE WHEN n_pairs < 1 THEN 0 WHEN p.ele_source = 'barometric' THEN CASE WHEN spikes THEN 0.55e0 ELSE 0.9e0 END WHEN noisy THEN 0.25e0 ELSE 0.6e0 END AS rel_trust FROM
        (SELECT q.*, rng, drifts, spikes, raw / nullif(rng, 0) AS ratio, wild OR (coalesce(median_m, 0) <= 80 AND coalesce(p75_delta >= 2 OR p95_delta >= 8, false) AND (coalesce(p95_grade >= 0.18, false) OR coalesce(p95_vertical_mps >= 0.5, false)))
            OR (q.ele_source <> 'barometric' AND CASE WHEN rng > 0 THEN raw / rng >= 12 ELSE raw > 0 END AND (coalesce(median_m, 0) <= 80 OR coalesce(p95_grade >= 0.18, false))) AS noisy FROM q JOIN h ON q.track_id = h.track_id AND q.ele_source = h.ele_source) p""",
    DENSE, *RUNNING,
    """d AS (SELECT *, CASE WHEN metres > 0 AND delta IS NOT NULL THEN metres END AS apart FROM (SELECT *, CASE WHEN NOT is_gap THEN abs(ele - lag(ele) OVER (PARTITION BY track_id, run ORDER BY i)) END AS delta FROM runs))""",
    """h AS (SELECT track_id, ele_source, sum(rng) AS rng, coalesce(bool_or(n >= 4 AND rng >= 8 AND p95 < 2 AND net >= 0.85 * raw AND raw > 0), false) AS drifts, coalesce(bool_or(p75 >= 2 OR p95 >= 8), false) AS spikes FROM
        (SELECT track_id, ele_source, run, count(*) AS n, max(ele) - min(ele) AS rng, abs(max_by(ele, i) - min_by(ele, i)) AS net, sum(delta) AS raw, quantile_disc(delta, 0.75) AS p75, quantile_disc(delta, 0.95) AS p95 FROM d GROUP BY ALL) GROUP BY ALL)""",
    """q AS (SELECT track_id, ele_source, count(delta) AS n_pairs, quantile_disc(delta, 0.75) AS p75_delta, quantile_disc(delta, 0.95) AS p95_delta, quantile_disc(apart, 0.5) AS median_m, quantile_disc(delta / apart, 0.95) AS p95_grade,
        quantile_disc(CASE WHEN dt > 0 THEN delta / dt END, 0.95) AS p95_vertical_mps, coalesce(sum(delta), 0) AS raw, coalesce(bool_or(delta >= 8 AND (coalesce(delta / apart >= 0.35, false) OR coalesce(dt > 0 AND delta / dt >= 1.2, false))), false) AS wild FROM d GROUP BY ALL)""",
)
ORACLE_SQL["slope_scale"] = (
    ORACLE_SQL["slope_asof"].replace("SELECT track_id, seq, round(CASE", "SELECT track_id, round(greatest(6e0, 1.2 * v[CAST(floor((len(v) - 1) * 0.92) AS INT) + 1]), 6) AS scale_pct FROM (SELECT track_id, list_sort(list(abs(CASE", 1)
    .replace("END, 6) AS slope_pct FROM q WHERE seq > 1", "END))) AS v FROM q WHERE seq > 1 AND ele IS NOT NULL GROUP BY track_id)", 1)
)

_ONE_SOURCE = DENSE.replace("CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END", "'unknown'")
ORACLE_SQL["time_zones"] = sql(
    """SELECT track_id, n_explicit, n_missing, n_invalid, n_unknown, CASE WHEN n_missing > 0 OR n_invalid > 0 THEN 'low' WHEN n_unknown > 0 THEN 'unknown' WHEN n_explicit > 0 THEN 'high' ELSE 'none' END AS confidence,
        CASE WHEN n_missing > 0 THEN 'tz_inferred' ELSE '' END AS flags FROM (SELECT track_id, count(*) FILTER (z = 'explicit') AS n_explicit, count(*) FILTER (z = 'missing') AS n_missing, count(*) FILTER (z = 'invalid') AS n_invalid,
        count(*) FILTER (z IS NULL OR z = 'none') AS n_unknown FROM (SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'explicit' ELSE (['explicit', 'missing', 'invalid', 'none', NULL])[seq % (track_id % 5 + 1) + 1] END AS z FROM pts) GROUP BY track_id)""",
    SPARSE,
)
ORACLE_SQL["noise_summary"] = sql("SELECT track_id, round(quantile_cont(sigma, 0.5), 6) AS median_sigma, round(quantile_cont(sigma, 0.95), 6) AS p95_sigma FROM sigmas GROUP BY track_id", SPARSE, *RUNNING, SIGMA)
ORACLE_SQL["elevation_series"] = sql(
    "SELECT track_id, run, i, round(d, 6) AS d, round(greatest(lo, least(hi, ele)), 6) AS ele FROM samples JOIN env USING (track_id)",
    _ONE_SOURCE, *RUNNING, PLAIN,
    """env AS (SELECT track_id, min(sane) AS lo, max(sane) AS hi FROM (SELECT track_id, CASE WHEN abs(ele - (l + h) / 2) > greatest(12e0, 3 * abs(h - l)) THEN (l + h) / 2 ELSE ele END AS sane FROM
        (SELECT *, lag(ele) OVER w AS l, lead(ele) OVER w AS h FROM runs WINDOW w AS (PARTITION BY track_id, run ORDER BY i))) GROUP BY track_id)""",
)
ORACLE_SQL["slow_progress"] = sql(
    f"""SELECT track_id, seq FROM (SELECT *, {dist("a_", "b_")} AS net, (b_t - a_t) / 1000e0 AS s FROM w WHERE n >= 5) WHERE s >= 120 AND net / s * 3.6 <= 1.5 AND (net / s * 3.6 >= 0.5 OR (net / s * 3.6 >= 0.15 AND net >= 12))""",
    DENSE.replace("43 + seq * 3e-5 + CASE WHEN e % 97 = 0 THEN 0.01e0 ELSE 0e0 END AS lat", "43 + seq * 4e-6 AS lat").replace("CAST((seq - 1) // 40 AS INT) AS segment", "0 AS segment"), PAIRS, GAPS,
    "g AS (SELECT *, sum(CASE WHEN same_segment = false OR is_gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS cs FROM gapped)",
    "c AS (SELECT track_id, cs, seq, (ts_ms + lag(ts_ms) OVER (PARTITION BY track_id, cs ORDER BY ts_ms)) // 2 AS centre FROM g)",
    """w AS (SELECT c.track_id, c.seq, count(*) AS n, min_by(g.lat, {'t': g.ts_ms, 's': g.seq}) AS a_lat, min_by(g.lon, {'t': g.ts_ms, 's': g.seq}) AS a_lon, min(g.ts_ms) AS a_t,
        max_by(g.lat, {'t': g.ts_ms, 's': g.seq}) AS b_lat, max_by(g.lon, {'t': g.ts_ms, 's': g.seq}) AS b_lon, max(g.ts_ms) AS b_t
        FROM c JOIN g ON g.track_id = c.track_id AND g.cs = c.cs AND g.ts_ms BETWEEN centre - 150000 AND centre + 150000 GROUP BY c.track_id, c.seq)""",
)
ORACLE_SQL["gradient_stops"] = sql(
    "SELECT track_id, round(p, 6) AS progress, round(max_by(kmh, seq), 6) AS kmh FROM (SELECT *, floor((distance_m - metres / 2) / t * 1000000 + 0.5) / 1000000 AS p FROM (SELECT *, max(distance_m) OVER (PARTITION BY track_id) AS t FROM speeds) WHERE t > 0) GROUP BY track_id, p",
    DENSE, *ROUTED, SPEED,
)
ORACLE_SQL["audit_trail"] = sql(
    """SELECT track_id, 'input' AS stage, 'n_points' AS item, CAST(count(*) AS VARCHAR) AS value FROM pairs GROUP BY track_id
        UNION ALL SELECT track_id, 'time', 'total_s', CAST(floor(sum(ms) / 1000e0 * 100 + 0.5) / 100 AS VARCHAR) FROM (SELECT track_id, segment, max(ts_ms) - min(ts_ms) AS ms FROM pts GROUP BY ALL) GROUP BY track_id
        UNION ALL SELECT track_id, 'time', 'mode', CASE WHEN median_gap_s IS NULL THEN 'untimed' WHEN median_gap_s <= 2 THEN 'dense' WHEN median_gap_s <= 15 THEN 'regular' WHEN median_gap_s <= 60 THEN 'smart' ELSE 'sparse' END FROM medians""",
    SPARSE, PAIRS, GAPS,
)
ORACLE_SQL["representative_point"] = sql(
    "SELECT track_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM pts) WHERE k = n // 2", SPARSE
)
ORACLE_SQL["speed_axis"] = sql("SELECT track_id, round(greatest(1.25e0 * max(kmh), max(kmh) + 1, 4e0), 6) AS top_kmh FROM speeds GROUP BY track_id", DENSE, *ROUTED, SPEED)
ORACLE_SQL["midpoint_values"] = sql(
    """SELECT p.track_id, p.seq, round(coalesce(a.kmh, (SELECT max_by(s.kmh, s.p) FROM stops s WHERE s.track_id = p.track_id)), 6) AS kmh FROM mids p ASOF LEFT JOIN stops a ON p.track_id = a.track_id AND p.at <= a.p""",
    DENSE, *ROUTED, SPEED,
    "mids AS (SELECT track_id, seq, (distance_m + b) / 2 / t AS at FROM (SELECT *, lag(distance_m) OVER (PARTITION BY track_id ORDER BY seq) AS b, max(distance_m) OVER (PARTITION BY track_id) AS t FROM route) WHERE b IS NOT NULL AND t > 0)",
    "stops AS (SELECT track_id, p, max_by(kmh, seq) AS kmh FROM (SELECT *, floor((distance_m - metres / 2) / t * 1000000 + 0.5) / 1000000 AS p FROM (SELECT *, max(distance_m) OVER (PARTITION BY track_id) AS t FROM speeds) WHERE t > 0) GROUP BY track_id, p)",
)

ORACLE_SQL["cleaning_summary"] = f"""SELECT track_id, CAST(sum(n) AS BIGINT) AS points_in, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS points_out,
    coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS reasons FROM (SELECT track_id, reason, count(*) AS n FROM ({ORACLE_SQL["cleaned_points"]}) GROUP BY ALL) GROUP BY track_id"""
_JITTER = ORACLE_SQL["xy_jitter"].replace("SELECT track_id, seq, round(metres, 6) AS metres FROM f WHERE shakes", "SELECT track_id, seq, shakes FROM f", 1)
ORACLE_SQL["route_jitter"] = sql(
    "SELECT track_id, sum(CASE WHEN shakes THEN 1 ELSE 0 END) AS n_jitter, sum(CASE WHEN shakes AND (run_n >= 25 OR (n > 1 AND sn = n - 1) OR (n > 8 AND sn >= 0.4 * (n - 1) AND span <= 25)) THEN 1 ELSE 0 END) AS n_route_jitter FROM w GROUP BY track_id",
    JITTERED, PAIRS, GAPS, f"j AS ({_JITTER})",
    """g AS (SELECT gapped.*, shakes, sum(CASE WHEN same_segment = false OR is_gap THEN 1 ELSE 0 END) OVER (PARTITION BY gapped.track_id ORDER BY gapped.seq) AS cs,
        sum(CASE WHEN shakes THEN 0 ELSE 1 END) OVER (PARTITION BY gapped.track_id ORDER BY gapped.seq) AS rn FROM gapped JOIN j ON gapped.track_id = j.track_id AND gapped.seq = j.seq)""",
    """b AS (SELECT track_id, cs, count(*) AS n, sum(CASE WHEN shakes THEN 1 ELSE 0 END) AS sn, min(lat) AS a_lat, max(lat) AS b_lat, min(lon) AS c_lon, max(lon) AS d_lon, (min(lon) + max(lon)) / 2 AS a_lon, (min(lon) + max(lon)) / 2 AS b_lon,
        (min(lat) + max(lat)) / 2 AS c_lat, (min(lat) + max(lat)) / 2 AS d_lat FROM g GROUP BY ALL)""",
    "rr AS (SELECT track_id, rn, sum(CASE WHEN shakes THEN 1 ELSE 0 END) AS run_n FROM g GROUP BY ALL)",
    f"w AS (SELECT g.track_id, shakes, run_n, n, sn, greatest({dist('a_', 'b_')}, {dist('c_', 'd_')}) AS span FROM g JOIN b ON g.track_id = b.track_id AND g.cs = b.cs JOIN rr ON g.track_id = rr.track_id AND g.rn = rr.rn)",
)
ORACLE_SQL["primary_source"] = f"""SELECT track_id, ele_source, trust FROM (SELECT track_id, ele_source, round(rel_trust, 6) AS trust, row_number() OVER (PARTITION BY track_id ORDER BY rel_trust DESC,
    list_position(['barometric', 'terrain', 'gpx', 'unknown'], ele_source)) AS k FROM ({ORACLE_SQL["source_trust"]}) WHERE rel_trust > 0) WHERE k = 1"""
ORACLE_SQL["base_threshold"] = f"""SELECT a.track_id, activity, ele_source, round(CASE WHEN activity <> 'water' AND ele_source = 'gpx' AND noisy AND change_ratio IS NOT NULL THEN greatest(d, least(18e0, 3 + 0.33 * greatest(0, change_ratio - 12))) ELSE d END, 6) AS base_m
    FROM (SELECT track_id, activity, CASE activity WHEN 'foot' THEN 3e0 WHEN 'bike' THEN 4e0 WHEN 'motor' THEN 6e0 WHEN 'route_plan' THEN 6e0 WHEN 'water' THEN 15e0 ELSE 5e0 END AS d FROM ({ORACLE_SQL["activity_features"]})) a
    JOIN (SELECT p.track_id, p.ele_source, noisy, change_ratio FROM ({ORACLE_SQL["primary_source"]}) p JOIN ({ORACLE_SQL["source_trust"]}) t ON p.track_id = t.track_id AND p.ele_source = t.ele_source) s ON a.track_id = s.track_id"""
_BEGINS, _TURNS = "dir = 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20", "dir <> 0 AND (ele - e) * dir < 0 AND abs(ele - e) >= 3 AND o.d - f.d >= 20"
_MOVES = f"({_BEGINS}) OR ({_TURNS}) OR (dir <> 0 AND (ele - e) * dir >= 0)"
#: Confirmed turns of ``samples``: a walk sample by sample; a turn is where the direction flips.
TURNS = (
    "o AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n FROM samples)",
    f"""f AS (SELECT track_id, run, 1 AS i, n, 0 AS dir, 1 AS ei, d, ele AS e FROM o WHERE i = 1
        UNION ALL SELECT o.track_id, o.run, o.i, o.n, CASE WHEN {_BEGINS} THEN CAST(sign(ele - e) AS INT) WHEN {_TURNS} THEN -dir ELSE dir END,
          CASE WHEN {_MOVES} THEN o.i ELSE ei END, CASE WHEN {_MOVES} THEN o.d ELSE f.d END, CASE WHEN {_MOVES} THEN ele ELSE e END FROM f JOIN o ON o.track_id = f.track_id AND o.run = f.run AND o.i = f.i + 1)""",
    """found AS (SELECT track_id, run, 1 AS i, d, ele FROM o WHERE i = 1 UNION ALL SELECT track_id, run, ei, d, e FROM f WHERE i = n AND dir <> 0 UNION ALL
        SELECT track_id, run, pi, pd, pe FROM (SELECT *, lag(dir) OVER w AS was, lag(ei) OVER w AS pi, lag(d) OVER w AS pd, lag(e) OVER w AS pe FROM f WINDOW w AS (PARTITION BY track_id, run ORDER BY i)) WHERE was <> 0 AND dir = -was)""",
    "turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id, run ORDER BY i) AS INT) AS k FROM found)",
)
_DENSE_ONE = DENSE.replace("CASE WHEN (seq - 1) // 20 % 2 = 0 THEN 'barometric' ELSE 'gpx' END", "'unknown'")
_FIXED = lambda x: f"(floor({x}) * 100 + ((CAST(floor(({x} - floor({x})) * 4503599627370496) AS BIGINT) * 100 + 2251799813685248) >> 52)) / 100"
ORACLE_SQL["confirmed_turns"] = sql("SELECT track_id, run, k, i, round(d, 6) AS d, round(ele, 6) AS ele FROM turns", _DENSE_ONE, *RUNNING, PLAIN, *TURNS, recursive=True)
ORACLE_SQL["threshold_sweep"] = sql(
    f"""SELECT track_id, kind, 5e0 AS threshold_m, {_FIXED("g")} AS gain_m, {_FIXED("l")} AS loss_m FROM (SELECT track_id, list_reduce(list_prepend(0e0, list(greatest(leg, 0e0) ORDER BY run, k)), lambda a, x: a + x) AS g,
        list_reduce(list_prepend(0e0, list(greatest(-leg, 0e0) ORDER BY run, k)), lambda a, x: a + x) AS l FROM legs GROUP BY track_id), (SELECT unnest(['selected_median_local_threshold', 'selected_p95_local_threshold']) AS kind)""",
    _DENSE_ONE, *RUNNING, PLAIN, *TURNS, "legs AS (SELECT *, coalesce(ele - lag(ele) OVER (PARTITION BY track_id, run ORDER BY k), 0e0) AS leg FROM turns)", recursive=True,
)
_SUPPORTED = (
    _DENSE_ONE, *RUNNING,
    "samples AS (SELECT track_id, run, i, i * 15e0 AS d, CASE WHEN i = 1 OR i = count(*) OVER (PARTITION BY track_id, run) THEN ele ELSE avg(ele) OVER (PARTITION BY track_id, run ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS ele FROM runs)",
    *TURNS,
    "raw AS (SELECT *, lag(ele) OVER w AS l, lead(ele) OVER w AS h FROM runs WINDOW w AS (PARTITION BY track_id, run ORDER BY i))",
    """env AS (SELECT track_id, run, min(CASE WHEN abs(ele - (l + h) / 2) > greatest(12e0, 3 * abs(h - l)) THEN (l + h) / 2 ELSE ele END) AS lo, max(CASE WHEN abs(ele - (l + h) / 2) > greatest(12e0, 3 * abs(h - l)) THEN (l + h) / 2 ELSE ele END) AS hi FROM raw GROUP BY ALL)""",
    "near AS (SELECT *, lag(d) OVER w AS pd, lead(d) OVER w AS nd FROM turns WINDOW w AS (PARTITION BY track_id, run ORDER BY k))",
    """held AS (SELECT track_id, run, k, i, d, ele FROM near t JOIN env USING (track_id, run) WHERE (pd IS NULL OR nd IS NULL OR (d - pd >= 30 AND nd - d >= 30))
        AND (ele >= lo OR EXISTS (SELECT 1 FROM raw x WHERE x.track_id = t.track_id AND x.run = t.run AND x.ele <= t.ele AND NOT coalesce(abs(x.ele - (x.l + x.h) / 2) > greatest(60e0, 3 * abs(x.h - x.l)), false)))
        AND (ele <= hi OR EXISTS (SELECT 1 FROM raw x WHERE x.track_id = t.track_id AND x.run = t.run AND x.ele >= t.ele AND NOT coalesce(abs(x.ele - (x.l + x.h) / 2) > greatest(60e0, 3 * abs(x.h - x.l)), false))))""",
)
ORACLE_SQL["supported_turns"] = sql("SELECT track_id, run, k, i, round(d, 6) AS d, round(ele, 6) AS ele FROM held", *_SUPPORTED, recursive=True)
ORACLE_SQL["confirmed_extrema"] = sql(
    """SELECT track_id, round(least(greatest(s.lo, e.lo), t.lo), 6) AS min_ele, round(greatest(least(s.hi, e.hi), t.hi), 6) AS max_ele FROM (SELECT track_id, min(ele) AS lo, max(ele) AS hi FROM samples GROUP BY track_id) s
        JOIN (SELECT track_id, min(lo) AS lo, max(hi) AS hi FROM env GROUP BY track_id) e USING (track_id) LEFT JOIN (SELECT track_id, min(ele) AS lo, max(ele) AS hi FROM held GROUP BY track_id) t USING (track_id)""",
    *_SUPPORTED, recursive=True,
)
ORACLE_SQL["endpoint_spikes"] = sql(
    """SELECT track_id, run, i, round(e, 6) AS ele, round(near[2], 6) AS clean FROM (SELECT *, list_sort(CASE WHEN i = 1 THEN [lead(e, 1) OVER w, lead(e, 2) OVER w, lead(e, 3) OVER w] ELSE [lag(e, 1) OVER w, lag(e, 2) OVER w, lag(e, 3) OVER w] END) AS near,
        count(*) OVER (PARTITION BY track_id, run) AS n, least(12e0, greatest(4e0, 0.15 * (max(e) OVER (PARTITION BY track_id, run) - min(e) OVER (PARTITION BY track_id, run)))) AS fl FROM s WINDOW w AS (PARTITION BY track_id, run ORDER BY i))
        WHERE n >= 4 AND (i = 1 OR i = n) AND near[3] - near[1] <= fl / 2 AND abs(e - near[2]) > greatest(4 * fl, 50e0)""",
    _ONE_SOURCE, *RUNNING, "s AS (SELECT track_id, run, i, ele / 8 + CASE WHEN i = 1 AND track_id % 2 = 0 THEN 70e0 ELSE 0e0 END AS e FROM runs)",
)
ORACLE_SQL["route_colours"] = sql(
    "SELECT track_id, seq, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(c IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS colour FROM u",
    DENSE, *ROUTED, SPEED,
    "k AS (SELECT track_id, seq, round(kmh, 3) AS kmh FROM speeds)",
    "sc AS (SELECT * FROM (SELECT track_id, quantile_cont(kmh, 0.1) AS lo, quantile_cont(kmh, 0.9) AS hi, count(*) AS n FROM k GROUP BY track_id) WHERE n >= 2 AND hi - lo >= 0.1)",
    "t AS (SELECT k.track_id, seq, greatest(0e0, least(1e0, (kmh - lo) / (hi - lo))) AS t FROM k JOIN sc ON k.track_id = sc.track_id)",
    "col AS (SELECT track_id, seq, printf('#%02x%02x%02x', CAST(floor(37 + 183 * t + 0.5) AS BIGINT), CAST(floor(99 - 61 * t + 0.5) AS BIGINT), CAST(floor(235 - 197 * t + 0.5) AS BIGINT)) AS c FROM t)",
    "u AS (SELECT p.track_id, p.seq, c FROM pts p LEFT JOIN col ON p.track_id = col.track_id AND p.seq = col.seq)",
)

_TENTH = lambda x: f"(format('{{:,}}', CAST(floor(({x}) * 10 + 0.5) AS BIGINT) // 10) || printf('.%d', CAST(floor(({x}) * 10 + 0.5) AS BIGINT) % 10))"
_CLOCK = "printf('%d:%02d:%02d', CAST(floor(total_s + 0.5) AS BIGINT) // 3600, CAST(floor(total_s + 0.5) AS BIGINT) % 3600 // 60, CAST(floor(total_s + 0.5) AS BIGINT) % 60)"
_TILES = [
    ("distance", "m", "total_distance_m", f"{_TENTH('total_distance_m / 1000')} || ' km'"), ("moving-time", "s", "NULL", "NULL"), ("stopped-time", "s", "NULL", "NULL"), ("total-time", "s", "total_s", _CLOCK),
    ("average-speed", "km/h", "average_kmh", f"{_TENTH('average_kmh')} || ' km/h'"), ("moving-speed", "km/h", "average_kmh", f"{_TENTH('average_kmh')} || ' km/h'"), ("max-speed", "km/h", "max_kmh", f"{_TENTH('max_kmh')} || ' km/h'"),
    ("elevation-gain", "m", "NULL", "NULL"), ("elevation-loss", "m", "NULL", "NULL"), ("min-elevation", "m", "min_ele", f"{_TENTH('min_ele')} || ' m'"), ("max-elevation", "m", "max_ele", f"{_TENTH('max_ele')} || ' m'"),
    ("elevation-range", "m", "max_ele - min_ele", f"{_TENTH('max_ele - min_ele')} || ' m'"),
]
ORACLE_SQL["metric_tiles"] = (
    f"WITH s AS (SELECT a.*, e.min_ele, e.max_ele FROM ({ORACLE_SQL['track_summary']}) a JOIN (SELECT user_id AS track_id, min(value) AS min_ele, max(value) AS max_ele FROM events GROUP BY user_id) e ON a.track_id = e.track_id) "
    + " UNION ALL ".join(f"SELECT track_id, '{m}' AS metric, '{u}' AS unit, CAST(round({v}, 6) AS DOUBLE) AS value, coalesce({t}, '—') AS text FROM s" for m, u, v, t in _TILES)
)
ORACLE_SQL["stated_summaries"] = f"""WITH s AS (SELECT a.track_id, CASE WHEN a.track_id % 2 = 0 THEN total_distance_m END AS d, CASE WHEN a.track_id % 3 <> 0 THEN total_s END AS t, CASE WHEN a.track_id % 3 = 1 THEN total_s / 2 END AS mv,
        CASE WHEN a.track_id % 4 = 1 THEN max_kmh END AS mx, CASE WHEN a.track_id % 5 <> 0 THEN e.lo END AS lo, CASE WHEN a.track_id % 7 <> 0 THEN e.hi END AS hi
        FROM ({ORACLE_SQL["track_summary"]}) a JOIN (SELECT user_id AS track_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id) e ON a.track_id = e.track_id)
    SELECT track_id, round(d, 6) AS total_distance_m, CAST(NULL AS DOUBLE) AS total_distance_3d_m, round(t, 6) AS total_s, round(mv, 6) AS moving_s, round(greatest(0e0, t - mv), 6) + CASE WHEN mv IS NULL THEN NULL ELSE 0e0 END AS stopped_s,
        round(CASE WHEN d > 0 AND t > 0 THEN d / t * 3.6 END, 6) AS average_kmh, round(CASE WHEN d > 0 AND mv > 0 THEN d / mv * 3.6 END, 6) AS moving_kmh, round(mx, 6) AS max_kmh, CAST(NULL AS DOUBLE) AS gain_m, CAST(NULL AS DOUBLE) AS loss_m,
        round(lo, 6) AS min_ele, round(hi, 6) AS max_ele, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN greatest(0e0, hi - lo) END, 6) AS range_m FROM s"""
ORACLE_SQL["raw_outliers"] = sql(
    """SELECT track_id, seq, run, i, round(CASE WHEN kind = 'interior' THEN four[2] ELSE est END, 6) AS ele, kind AS raw_outlier FROM (SELECT *, CASE
        WHEN n >= 3 AND (i = 1 OR i = n) AND len(near) >= 2 AND near[len(near)] - near[1] <= fl / 2 AND abs(ele - est) > greatest(4 * fl, 50e0) AND (coalesce(way > 0 AND st / way >= 0.35, false) OR coalesce(tm > 0 AND st / tm >= 1.2, false)
            OR (NOT coalesce(way > 0, false) AND NOT coalesce(tm > 0, false))) THEN CASE WHEN i = 1 THEN 'first' ELSE 'last' END
        WHEN i BETWEEN 3 AND n - 2 AND four[4] - four[1] <= greatest(1e0, abs(b1 - a1)) AND least(abs(ele - four[2]), abs(ele - b1), abs(ele - a1)) > greatest(60e0, 4 * fl) AND abs(ele - four[2]) > 4 * abs(b1 - a1) THEN 'interior' END AS kind FROM z) WHERE kind IS NOT NULL""",
    _ONE_SOURCE.replace("END END AS ele", "END - CASE WHEN track_id % 2 = 0 AND seq % 40 = 1 THEN 90e0 ELSE 0e0 END END AS ele"), *RUNNING,
    """x AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n, least(12e0, greatest(4e0, 0.15 * (max(ele) OVER (PARTITION BY track_id, run) - min(ele) OVER (PARTITION BY track_id, run)))) AS fl,
        lag(ele) OVER w AS b1, lag(ele, 2) OVER w AS b2, lag(ele, 3) OVER w AS b3, lead(ele) OVER w AS a1, lead(ele, 2) OVER w AS a2, lead(ele, 3) OVER w AS a3, lead(metres) OVER w AS nm, lead(dt) OVER w AS ns FROM runs WINDOW w AS (PARTITION BY track_id, run ORDER BY i))""",
    """y AS (SELECT *, list_sort(list_filter(CASE WHEN i = 1 THEN [a1, a2, a3] ELSE [b1, b2, b3] END, lambda q: q IS NOT NULL)) AS near, list_sort([b2, b1, a1, a2]) AS four, CASE WHEN i = 1 THEN nm ELSE metres END AS way, abs(CASE WHEN i = 1 THEN ns ELSE dt END) AS tm FROM x)""",
    "z AS (SELECT *, near[(len(near) - 1) // 2 + 1] AS est, greatest(abs(ele - CASE WHEN i = 1 THEN a1 ELSE b1 END), abs(ele - near[(len(near) - 1) // 2 + 1])) AS st FROM y)",
)

#: Tails as intervals and joins: seeds' islands, grown by the nearest sample outside the rim, tested by looking up their ends.
TAILED = SUPPLIER.replace("pts AS (", "plain AS (") + """,
pts AS (SELECT track_id, seq, ts_ms + CASE WHEN v = 2 AND k >= 493 THEN 2400000 ELSE 0 END AS ts_ms, CASE WHEN v = 3 THEN 43 + seq * 4e-4 ELSE lat END AS lat, lon, segment, ele_source, CASE
    WHEN v = 0 AND k BETWEEN 200 AND 209 THEN -14e0 - k % 3 WHEN v = 0 AND k BETWEEN 196 AND 213 THEN b * 0.2e0 WHEN v = 1 AND k <= 8 THEN b + 75 WHEN v = 2 AND k >= 486 THEN
        CASE WHEN k <= 488 THEN 20e0 WHEN k = 489 THEN 21e0 WHEN k = 490 THEN 23e0 WHEN k = 491 THEN 26e0 WHEN k = 492 THEN 31e0 ELSE 75e0 END
    WHEN v = 3 AND k <= 12 THEN -15e0 WHEN v = 4 AND k BETWEEN 200 AND 240 THEN -14e0 WHEN v = 5 AND k BETWEEN 200 AND 209 THEN -14e0 WHEN v = 5 AND k BETWEEN 180 AND 240 THEN b * 0.1e0 ELSE b END AS ele
    FROM (SELECT *, track_id % 6 AS v, (seq - 1) % 500 + 1 AS k, 12 + (ele - 100) * 0.4e0 AS b FROM plain))"""
_DONE = ORACLE_SQL["raw_outliers"]
_CALM = _DONE[_DONE.index("x AS (SELECT *, count(*)"):_DONE.index(" SELECT track_id, seq, run, i, round(CASE WHEN kind")]
_KIND = _DONE[_DONE.index("(SELECT *, CASE\n"):_DONE.rindex(" WHERE kind IS NOT NULL")]


def _tested(name: str, source: str) -> str:
    """Intervals l to r of a run that have too little support to be kept: lookups of both ends, of what lies beside them and
    of the run's ends."""
    step = lambda e, x: f"({x}.i IS NOT NULL AND (coalesce({dist(e + '.', x + '.')} > 0, false) OR coalesce({e}.ts_ms <> {x}.ts_ms, false)) AND NOT coalesce(abs({e}.ele - {x}.ele) / nullif({dist(e + '.', x + '.')}, 0) >= 0.35, false) AND NOT coalesce(abs({e}.ele - {x}.ele) / nullif(abs({e}.ts_ms - {x}.ts_ms) / 1000e0, 0) >= 1.2, false))"
    return f"""{name} AS (SELECT s.* FROM {source} s JOIN o a ON a.track_id = s.track_id AND a.run = s.run AND a.i = s.l JOIN o b ON b.track_id = s.track_id AND b.run = s.run AND b.i = s.r
        JOIN o f ON f.track_id = s.track_id AND f.run = s.run AND f.i = 1 JOIN o z ON z.track_id = s.track_id AND z.run = s.run AND z.i = z.n
        LEFT JOIN o p ON p.track_id = s.track_id AND p.run = s.run AND p.i = s.l - 1 LEFT JOIN o q ON q.track_id = s.track_id AND q.run = s.run AND q.i = s.r + 1
        WHERE (s.r - s.l + 1) / f.n <= 0.05 AND NOT coalesce((b.d - a.d) / nullif(z.d - f.d, 0) > 0.08, false) AND NOT coalesce(greatest(0, b.ts_ms - a.ts_ms) / nullif(greatest(0, z.ts_ms - f.ts_ms), 0) > 0.08, false)
        AND NOT (s.l = 1 AND {step("a", "q")}) AND NOT (s.r = f.n AND {step("b", "p")}))"""


def _islands(name: str, source: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, min(i) AS l, max(i) AS r FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS g FROM {source}) GROUP BY {keys}, g)"


TAILS = (
    TAILED, *RUNNING, _CALM,
    f"calm AS (SELECT track_id, seq, run, i, ts_ms, lat, lon, metres, CASE WHEN kind = 'interior' THEN four[2] WHEN kind IS NOT NULL THEN est ELSE ele END AS ele FROM {_KIND})",
    "q AS (SELECT track_id, run, count(*) AS n, quantile_cont(ele, 0.1) AS t10, quantile_cont(ele, 0.12) AS t12, quantile_cont(ele, 0.15) AS t15, quantile_cont(ele, 0.85) AS t85, quantile_cont(ele, 0.9) AS t90 FROM calm GROUP BY track_id, run)",
    "o AS (SELECT c.*, n, t10, t12, t15, t85, t90, sum(CASE WHEN i > 1 THEN metres ELSE 0e0 END) OVER (PARTITION BY c.track_id, c.run ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM calm c JOIN q ON c.track_id = q.track_id AND c.run = q.run)",
    "sd AS (SELECT 'low' AS kind, track_id, run, i FROM o WHERE n >= 80 AND ele < t15 - 20 AND ele < 0 UNION ALL SELECT 'high', track_id, run, i FROM o WHERE n >= 80 AND ele > t85 + 20)",
    _islands("isl", "sd", "kind, track_id, run"),
    """gr AS (SELECT s.kind, s.track_id, s.run, s.l AS a, s.r AS b, any_value(t10) AS t10, coalesce(max(i) FILTER (i < s.l AND NOT rim), 0) + 1 AS l, coalesce(min(i) FILTER (i > s.r AND NOT rim), any_value(n) + 1) - 1 AS r
        FROM isl s JOIN (SELECT *, ele < t12 AS lo, ele > t90 AS hi FROM o) o ON o.track_id = s.track_id AND o.run = s.run, LATERAL (SELECT CASE WHEN kind = 'low' THEN lo ELSE hi END AS rim) GROUP BY ALL)""",
    "wide AS (SELECT track_id, run, l, r, a, b FROM gr WHERE kind = 'low' AND t10 <= 25)", _tested("wide_ok", "wide"),
    "core AS (SELECT track_id, run, a AS l, b AS r FROM gr g WHERE kind = 'low' AND NOT EXISTS (FROM wide_ok w WHERE w.track_id = g.track_id AND w.run = g.run AND w.a = g.a))", _tested("core_ok", "core"),
    "cov AS (SELECT DISTINCT o.track_id, o.run, o.i FROM gr g JOIN o ON o.track_id = g.track_id AND o.run = g.run AND o.i BETWEEN g.l AND g.r WHERE g.kind = 'high')", _islands("tops", "cov", "track_id, run"),
    "ends AS (SELECT t.* FROM tops t JOIN q ON q.track_id = t.track_id AND q.run = t.run WHERE l = 1 OR r = n)", _tested("ends_ok", "ends"),
    """cand AS (SELECT DISTINCT kind, o.track_id, o.run, o.i FROM (SELECT 'low' AS kind, track_id, run, l, r FROM wide_ok UNION ALL SELECT 'low', track_id, run, l, r FROM core_ok UNION ALL SELECT 'high', track_id, run, l, r FROM ends_ok) g
        JOIN o ON o.track_id = g.track_id AND o.run = g.run AND o.i BETWEEN g.l AND g.r)""",
)
ORACLE_SQL["tail_marks"] = sql(
    """SELECT o.track_id, o.run, count(*) AS n, count(l.i) AS n_low, count(h.i) AS n_high, CAST(sum(coalesce(l.i, h.i)) AS BIGINT) AS places FROM o LEFT JOIN cand l ON l.kind = 'low' AND l.track_id = o.track_id AND l.run = o.run AND l.i = o.i
        LEFT JOIN cand h ON h.kind = 'high' AND h.track_id = o.track_id AND h.run = o.run AND h.i = o.i GROUP BY o.track_id, o.run""",
    *TAILS,
)
ORACLE_SQL["sparse_tails"] = sql(
    "SELECT track_id, seq, run, i, round(new, 6) AS ele FROM (SELECT o.track_id, o.seq, o.run, o.i, arg_max(e, kind = 'high') AS new FROM news JOIN o ON o.track_id = news.track_id AND o.run = news.run AND o.i = news.i WHERE e IS NOT NULL GROUP BY ALL)",
    *TAILS, _islands("groups", "cand", "kind, track_id, run"),
    "sides AS (SELECT *, l - 1 AS anchor, l AS edge, -1 AS way FROM groups UNION ALL SELECT *, r + 1, r, 1 FROM groups)",
    """looks AS (SELECT s.kind, s.track_id, s.run, s.anchor, s.way, abs(o.i - s.anchor) AS k, o.i, o.d, o.ele, o.ts_ms, c.i IS NOT NULL AS blocked FROM sides s JOIN o ON o.track_id = s.track_id AND o.run = s.run AND (o.i - s.anchor) * s.way BETWEEN 1 AND 6
        LEFT JOIN cand c ON c.kind = s.kind AND c.track_id = o.track_id AND c.run = o.run AND c.i = o.i)""",
    """seen AS (SELECT l.* FROM looks l JOIN (SELECT kind, track_id, run, anchor, way, coalesce(min(k) FILTER (blocked), 7) AS stop FROM looks GROUP BY ALL) USING (kind, track_id, run, anchor, way) WHERE k < stop)""",
    "lists AS (SELECT kind, track_id, run, anchor, way, list({'i': i, 'd': d, 'e': ele, 't': ts_ms} ORDER BY k) AS v, count(*) AS m FROM seen GROUP BY ALL)",
    "level AS (SELECT *, list_sort([v[m - 2].e, v[m - 1].e, v[m].e]) AS s FROM lists WHERE m >= 3)",
    """settle AS (SELECT l.kind, l.track_id, l.run, l.anchor, l.way, list_filter(v, lambda x: abs(x.e - s[2]) <= 2.5)[1] AS p, s[2] - a.ele AS whole, v[1].e - a.ele AS one, a.d AS ad, a.ts_ms AS ats FROM level l
        JOIN o a ON a.track_id = l.track_id AND a.run = l.run AND a.i = l.anchor JOIN o b ON b.track_id = l.track_id AND b.run = l.run AND b.i = l.anchor - l.way WHERE s[3] - s[1] <= 2.5 AND abs(a.ts_ms - b.ts_ms) >= 1800000)""",
    "moved AS (SELECT *, p.i AS si FROM settle WHERE sign(whole) = sign(one) AND abs(one) >= 2 AND abs(whole) >= 6 AND (abs(p.d - ad) = 0 OR abs(whole) / abs(p.d - ad) > 0.35 OR coalesce(abs(whole) / nullif(abs(p.t - ats) / 1000e0, 0) > 1.2, false)))",
    """held AS (SELECT s.kind, s.track_id, s.run, s.l, s.r, s.way, o.i, o.d, o.ele FROM sides s LEFT JOIN moved m ON m.kind = s.kind AND m.track_id = s.track_id AND m.run = s.run AND m.anchor = s.anchor AND m.way = s.way
        JOIN o ON o.track_id = s.track_id AND o.run = s.run AND o.i = coalesce(m.si, s.anchor))""",
    """news AS (SELECT c.kind, c.track_id, c.run, c.i, CASE WHEN p.i IS NULL THEN q.ele WHEN q.i IS NULL THEN p.ele ELSE p.ele + (q.ele - p.ele) * least(1e0, greatest(0e0, CASE WHEN q.d > p.d THEN (o.d - p.d) / (q.d - p.d) ELSE (c.i - p.i) / (q.i - p.i) END)) END AS e
        FROM cand c JOIN o ON o.track_id = c.track_id AND o.run = c.run AND o.i = c.i JOIN groups g ON g.kind = c.kind AND g.track_id = c.track_id AND g.run = c.run AND c.i BETWEEN g.l AND g.r
        LEFT JOIN held p ON p.way = -1 AND p.kind = g.kind AND p.track_id = g.track_id AND p.run = g.run AND p.l = g.l LEFT JOIN held q ON q.way = 1 AND q.kind = g.kind AND q.track_id = g.track_id AND q.run = g.run AND q.l = g.l
        UNION ALL SELECT kind, track_id, run, anchor, p.e FROM (SELECT m.kind, m.track_id, m.run, m.anchor, m.p FROM moved m))""",
)


def _poor(name: str, source: str, efficiency: float, back: float) -> str:
    """Pairs (track_id, pair) whose points in ``source`` go to and fro along their longer axis."""
    w = "PARTITION BY track_id, pair ORDER BY t, seq"
    return f"""{name}_a AS (SELECT *, (lon - first_value(lon) OVER ({w})) * 111319.49079327357 * cos(radians(first_value(lat) OVER ({w}))) AS x, (lat - first_value(lat) OVER ({w})) * 111319.49079327357 AS y FROM {source}),
    {name}_b AS (SELECT *, CASE WHEN max(x) OVER p - min(x) OVER p >= max(y) OVER p - min(y) OVER p THEN x ELSE y END AS v FROM {name}_a WINDOW p AS (PARTITION BY track_id, pair)),
    {name}_c AS (SELECT *, v - lag(v) OVER ({w}) AS dv FROM {name}_b),
    {name}_n AS (SELECT track_id, pair, count(*) AS n, max_by(v, {{'t': t, 's': seq}}) - min_by(v, {{'t': t, 's': seq}}) AS net FROM {name}_c GROUP BY ALL),
    {name}_d AS (SELECT *, sign(dv) AS sg, lag(sign(dv)) OVER ({w}) AS psg FROM {name}_c WHERE abs(dv) >= 1),
    {name} AS (SELECT track_id, pair FROM (SELECT d.track_id, d.pair, any_value(net) AS net, any_value(n) AS n, sum(abs(dv)) AS path, coalesce(sum(abs(dv)) FILTER (net <> 0 AND sg <> sign(net)), 0) AS bk, count(*) FILTER (psg <> sg) AS rev
        FROM {name}_d d JOIN {name}_n m ON m.track_id = d.track_id AND m.pair = d.pair GROUP BY ALL) WHERE n >= 3 AND rev >= 3 AND abs(net) / path < {efficiency} AND (net = 0 OR bk / abs(net) >= {back}))"""


ORACLE_SQL["slow_scopes"] = sql(
    """SELECT s.track_id, s.seq, nr.pair IS NOT NULL AS poor_window, br.pair IS NOT NULL AS poor_broad, sg.pair IS NOT NULL AS poor_segment FROM slow s LEFT JOIN poor_near nr ON nr.track_id = s.track_id AND nr.pair = s.seq
        LEFT JOIN poor_broad br ON br.track_id = s.track_id AND br.pair = s.seq LEFT JOIN poor_all sg ON sg.track_id = s.track_id AND sg.pair = s.cs""",
    SUPPLIER.replace("pts AS (", "plain AS (") + """,
    pts AS (SELECT track_id, seq, ts_ms, 43 + CASE WHEN track_id % 3 = 2 THEN 0.4e0 * t ELSE 0.4e0 * least(fmod(t, 2 * leg), 2 * leg - fmod(t, 2 * leg)) END / 111320e0 AS lat, lon, ele, segment, ele_source
        FROM (SELECT *, ts_ms / 1000e0 AS t, CASE WHEN track_id % 3 = 0 THEN 225e0 ELSE 250e0 END AS leg FROM plain))""", PAIRS, GAPS,
    "g AS (SELECT *, sum(CASE WHEN same_segment = false OR is_gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS cs FROM gapped)",
    "c AS (SELECT track_id, cs, seq, ts_ms, lag(ts_ms) OVER w AS was, (ts_ms + lag(ts_ms) OVER w) // 2 AS centre, min(ts_ms) OVER (PARTITION BY track_id, cs) AS lo, max(ts_ms) OVER (PARTITION BY track_id, cs) AS hi, count(*) OVER (PARTITION BY track_id, cs) AS n FROM g WINDOW w AS (PARTITION BY track_id, cs ORDER BY ts_ms))",
    "near AS (SELECT c.track_id, c.cs, c.seq AS pair, g.seq, g.ts_ms AS t, g.lat, g.lon FROM c JOIN g ON g.track_id = c.track_id AND g.cs = c.cs AND g.ts_ms BETWEEN centre - 150000 AND centre + 150000)",
    "w AS (SELECT track_id, cs, pair, count(*) AS n, min_by(lat, t) AS a_lat, min_by(lon, t) AS a_lon, min(t) AS a_t, max_by(lat, t) AS b_lat, max_by(lon, t) AS b_lon, max(t) AS b_t FROM near GROUP BY ALL)",
    f"""slow AS (SELECT track_id, cs, pair AS seq FROM (SELECT *, {dist("a_", "b_")} AS net, (b_t - a_t) / 1000e0 AS s FROM w WHERE n >= 5) WHERE s >= 120 AND net / s * 3.6 <= 1.5 AND (net / s * 3.6 >= 0.5 OR (net / s * 3.6 >= 0.15 AND net >= 12)))""",
    "near_slow AS (SELECT n.* FROM near n SEMI JOIN slow s ON s.track_id = n.track_id AND s.seq = n.pair)", _poor("poor_near", "near_slow", 0.45, 1),
    """span AS (SELECT track_id, cs, seq AS pair, CASE WHEN b > hi THEN greatest(lo, hi - 900000) ELSE a END AS a, least(b, hi) AS b, was, ts_ms FROM (SELECT c.*, CASE WHEN centre - 450000 < lo THEN lo ELSE centre - 450000 END AS a,
        CASE WHEN centre - 450000 < lo THEN least(hi, lo + 900000) ELSE centre + 450000 END AS b FROM c SEMI JOIN slow s ON s.track_id = c.track_id AND s.seq = c.seq))""",
    "wide AS (SELECT s.track_id, s.pair, g.seq, g.ts_ms AS t, g.lat, g.lon FROM span s JOIN g ON g.track_id = s.track_id AND g.cs = s.cs AND g.ts_ms BETWEEN s.a AND s.b WHERE s.was >= s.a AND s.ts_ms <= s.b)", _poor("poor_broad", "wide", 0.03, 20),
    "small AS (SELECT g.track_id, g.cs AS pair, g.seq, g.ts_ms AS t, g.lat, g.lon FROM g JOIN (SELECT DISTINCT track_id, cs, n FROM c WHERE n <= 120) k ON k.track_id = g.track_id AND k.cs = g.cs)", _poor("poor_all", "small", 0.45, 1),
)

_COLOUR = "printf('#%02x%02x%02x', CAST(floor(37 + 183 * t + 0.5) AS BIGINT), CAST(floor(99 - 61 * t + 0.5) AS BIGINT), CAST(floor(235 - 197 * t + 0.5) AS BIGINT))"
#: Stops from ``line`` (track_id, k, kmh, p): the scale of its speeds, colours, ends, and the last writer at equal progress.
STOPS = (
    "sc AS (SELECT * FROM (SELECT track_id, quantile_cont(kmh, 0.1) AS lo, quantile_cont(kmh, 0.9) AS hi, count(*) AS n FROM scaled GROUP BY track_id) WHERE n >= 2 AND hi - lo >= 0.1)",
    f"hue AS (SELECT track_id, k, p, {_COLOUR} AS c FROM (SELECT l.*, greatest(0e0, least(1e0, (kmh - lo) / (hi - lo))) AS t FROM line l JOIN sc ON sc.track_id = l.track_id))",
    "rim AS (SELECT track_id, k, 1 AS own, floor(greatest(0, least(1, p)) * 1000000 + 0.5) / 1000000 AS p, c FROM hue UNION ALL SELECT track_id, min(k), 0, 0e0, min_by(c, k) FROM hue GROUP BY track_id UNION ALL SELECT track_id, max(k), 2, 1e0, max_by(c, k) FROM hue GROUP BY track_id)",
    "stop AS (SELECT track_id, p, max_by(c, {'k': k, 'o': own}) AS c FROM rim GROUP BY track_id, p)",
)
ORACLE_SQL["stops_by_way"] = sql(
    "SELECT track_id, round(p, 6) AS progress, c AS colour FROM stop",
    SUPPLIER, *ROUTED, SPEED,
    "got AS (SELECT track_id, seq, distance_m, metres, round(kmh, 3) AS kmh FROM speeds WHERE track_id % 5 <> 1 OR seq % 97 <> 5)",
    "twice AS (SELECT * FROM got UNION ALL SELECT * FROM got WHERE track_id % 5 = 2 AND seq = 100)",
    "lead_in AS (SELECT *, row_number() OVER w AS k, distance_m - metres AS s, coalesce(lag(distance_m) OVER w, 0e0) AS b FROM twice WHERE metres > 0 WINDOW w AS (PARTITION BY track_id ORDER BY distance_m, seq))",
    "total AS (SELECT track_id, max(distance_m) + CASE WHEN track_id % 5 = 3 THEN 1.5e0 ELSE 0.5e0 END AS m FROM route GROUP BY track_id)",
    "fit AS (SELECT l.track_id FROM lead_in l JOIN total t ON t.track_id = l.track_id GROUP BY l.track_id HAVING bool_and(abs(s - b) <= 1) AND abs(max(distance_m) - any_value(m)) <= 1 AND count(*) >= 2)",
    "line AS (SELECT l.track_id, k, kmh, distance_m / m AS p FROM lead_in l JOIN fit f ON f.track_id = l.track_id JOIN total t ON t.track_id = l.track_id)", "scaled AS (SELECT * FROM line)", *STOPS,
)
ORACLE_SQL["stops_by_point"] = sql(
    "SELECT track_id, round(p, 6) AS progress, c AS colour FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS m FROM stop) WHERE m >= 2",
    DENSE, *ROUTED, SPEED, "scaled AS (SELECT track_id, seq, round(kmh, 3) AS kmh FROM speeds)",
    "drawn AS (SELECT track_id, seq, sum(coalesce(metres, 0e0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS d FROM pairs)",
    "line AS (SELECT s.track_id, s.seq AS k, s.kmh, d.d / t.t AS p FROM scaled s JOIN drawn d ON d.track_id = s.track_id AND d.seq = s.seq JOIN (SELECT track_id, max(d) AS t FROM drawn GROUP BY track_id) t ON t.track_id = s.track_id)", *STOPS,
)
ORACLE_SQL["outlier_details"] = sql(
    f"SELECT track_id, CAST(k AS INT) AS k, seq, {r('kmh', 'dt', 'metres')}, round(distance_m - metres, 6) AS start_m, {r('distance_m')}, n_outliers FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY track_id) AS n_outliers FROM speeds JOIN (SELECT track_id, ceiling_kmh FROM ceilings) USING (track_id) WHERE kmh > ceiling_kmh) WHERE k <= 5",
    DENSE, *ROUTED, SPEED.replace("speeds AS (", "slower AS (") + ", speeds AS (SELECT * REPLACE (kmh + CASE WHEN seq % 9 = 0 THEN 40e0 ELSE 0e0 END AS kmh) FROM slower)", RELIABLE,
)

_TEXT = lambda x: f"coalesce(format('{{:d}}', CAST({x} AS BIGINT)), '0')"
_METRES = lambda x: f"coalesce(printf('%d m', CAST({x} AS BIGINT)), 'n/a')"
_ITEMS = [
    (0, 0, "input", "'ok'", "inputPoints", "Points", "count", "pin", _TEXT("pin")), (0, 1, "input", "'ok'", "mode", "Mode", "analysisMode", "m", "m"),
    (1, 0, "cleaning", "CASE WHEN pin > n THEN 'changed' ELSE 'ok' END", "keptPoints", "Points", "keptCount", "n", f"{_TEXT('n')} || ' kept'"), (1, 1, "cleaning", "CASE WHEN pin > n THEN 'changed' ELSE 'ok' END", "removedPoints", "Removed", "count", "pin - n", _TEXT("pin - n")),
    (2, 0, "continuity", "CASE WHEN g > 0 OR j > 0 THEN 'changed' ELSE 'ok' END", "timeGaps", "Time gaps", "count", "g", _TEXT("g")), (2, 1, "continuity", "CASE WHEN g > 0 OR j > 0 THEN 'changed' ELSE 'ok' END", "xyJitter", "XY jitter", "count", "j", _TEXT("j")),
    (3, 0, "elevation", "CASE WHEN th IS NULL THEN 'ok' ELSE 'changed' END", "elevationSource", "Source", "elevationSource", "coalesce(src, 'none')", "coalesce(src, 'none')"),
    (3, 1, "elevation", "CASE WHEN th IS NULL THEN 'ok' ELSE 'changed' END", "threshold", "Threshold", "meters", "CAST(th AS DOUBLE)", _METRES("th")),
    (3, 2, "elevation", "CASE WHEN th IS NULL THEN 'ok' ELSE 'changed' END", "thresholdSweep", "Sweep", "thresholdSweep", "CASE WHEN th IS NOT NULL THEN 'median/p95' END", f"CASE WHEN th IS NULL THEN 'n/a' ELSE 'median: ' || {_METRES('th')} || ' / p95: ' || {_METRES('t % 11')} END"),
    (4, 0, "movement", "'changed'", "movingTime", "Moving time", "seconds", "CAST(mv AS DOUBLE)", "coalesce(printf('%d s', CAST(mv AS BIGINT)), 'n/a')"), (4, 1, "movement", "'changed'", "startSpeed", "Start speed", "kmh", "'1.5'", "'1.5 km/h'"),
    (5, 0, "sampling", "CASE WHEN md IN ('smart', 'sparse') THEN 'warning' ELSE 'ok' END", "recording", "Recording", "recordingMode", "md", "md"), (5, 1, "sampling", "CASE WHEN md IN ('smart', 'sparse') THEN 'warning' ELSE 'ok' END", "interval", "Interval", "seconds", "CAST(round(nominal_s) AS DOUBLE)", "coalesce(printf('%d s', CAST(round(nominal_s) AS BIGINT)), 'n/a')"),
    (6, 0, "summary", "st", "distance", "Distance", "meters", "CASE WHEN im THEN CAST(t * 10 AS DOUBLE) ELSE round(total_distance_m) END", f"CASE WHEN im THEN {_METRES('t * 10')} ELSE {_METRES('round(total_distance_m)')} END"),
    (6, 1, "summary", "st", "elevationGain", "Elevation gain", "meters", "CASE WHEN NOT im THEN CAST(t % 13 AS DOUBLE) END", f"CASE WHEN im THEN 'n/a' ELSE {_METRES('t % 13')} END"),
    (6, 2, "summary", "st", "CASE WHEN im THEN 'source' ELSE 'flags' END", "CASE WHEN im THEN 'Source' ELSE 'Flags' END", "CASE WHEN im THEN 'sourceTag' ELSE 'count' END", "CASE WHEN im THEN 'gpx' ELSE CAST(nf AS VARCHAR) END", f"CASE WHEN im THEN 'gpx' ELSE {_TEXT('nf')} END"),
    (6, 3, "summary", "st", "CASE WHEN im THEN 'flags' ELSE 'timeZone' END", "CASE WHEN im THEN 'Flags' ELSE 'Time zone' END", "CASE WHEN im THEN 'count' ELSE 'timeZoneConfidence' END", "CASE WHEN im THEN CAST(nf AS VARCHAR) ELSE 'unknown' END", f"CASE WHEN im THEN {_TEXT('nf')} ELSE 'unknown' END"),
]
_NAME = lambda x: x if x.startswith("CASE") else f"'{x}'"
ORACLE_SQL["audit_stages"] = f"""WITH s AS ({ORACLE_SQL["track_summary"]}), g AS (SELECT track_id, CAST(sum(CAST(is_gap AS INT)) AS BIGINT) AS g, count(DISTINCT segment) AS ns FROM ({sql("SELECT * FROM gapped", SPARSE, PAIRS, GAPS)}) GROUP BY track_id),
    f AS (SELECT s.*, s.mode AS md, s.track_id AS t, g, n_points AS n, n_points + s.track_id % 4 AS pin, s.track_id % 3 AS j, s.track_id % 2 = 0 AS im, CASE WHEN s.track_id % 2 = 0 THEN 'imported_summary' ELSE 'recomputed_filtered' END AS m,
        CASE WHEN s.track_id % 5 <> 0 THEN 'gpx' END AS src, CASE WHEN s.track_id % 5 <> 0 THEN s.track_id % 7 END AS th, CASE WHEN s.track_id % 6 <> 1 THEN round(total_s) END AS mv,
        CAST(s.mode IN ('smart', 'sparse') AS INT) + CAST(ns > 1 AS INT) + CAST(g > 0 AS INT) + CAST(s.track_id % 3 > 0 AS INT) AS nf FROM s JOIN g ON g.track_id = s.track_id),
    h AS (SELECT *, CASE WHEN im OR nf > 0 THEN 'warning' ELSE 'ok' END AS st FROM f) """ + " UNION ALL ".join(
    f"SELECT t AS track_id, m AS mode, {n} AS n, {k} AS k, '{stage}' AS stage, {status} AS status, {_NAME(i)} AS item, {_NAME(label)} AS label, {_NAME(kind)} AS value_type, CAST({raw} AS VARCHAR) AS raw_value, {text} AS value FROM h" for n, k, stage, status, i, label, kind, raw, text in _ITEMS
)
ORACLE_SQL["next_modes"] = """SELECT track_id, CASE WHEN coalesce(l, 'recomputed_filtered') <> coalesce(d, 'recomputed_filtered') AND list_contains(ms, CASE WHEN coalesce(l, 'recomputed_filtered') = 'recomputed_basecamp' THEN 'recomputed_filtered' ELSE coalesce(l, 'recomputed_filtered') END)
    THEN coalesce(l, 'recomputed_filtered') WHEN track_id % 3 = 0 THEN 'recomputed_terrain' ELSE 'recomputed_filtered' END AS next_mode FROM (SELECT DISTINCT user_id AS track_id, [NULL, 'recomputed_filtered', 'recomputed_raw', 'recomputed_terrain', 'imported_summary', 'recomputed_basecamp'][user_id % 6 + 1] AS l,
    CASE WHEN user_id % 4 = 1 THEN 'recomputed_terrain' END AS d, list_concat(['recomputed_filtered', 'recomputed_raw'], CASE WHEN user_id % 3 = 0 THEN ['recomputed_terrain'] ELSE [] END, CASE WHEN user_id % 2 = 0 THEN ['imported_summary'] ELSE [] END) AS ms FROM events)"""

ORACLE_SQL["gpx_documents"] = f"""WITH {DENSE}, found AS (SELECT *, (seq - 1) // 4000 AS part, seq % 31 = 0 AS routed FROM pts WHERE seq % 29 <> 0 OR seq % 31 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY routed, seq) AS k,
        dense_rank() OVER (PARTITION BY track_id, part ORDER BY CASE WHEN routed THEN 1000000000 ELSE segment END) - 1 AS place FROM found)
    SELECT track_id, CAST(part AS BIGINT) AS part, CAST(k AS INT) AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon, round(CASE WHEN seq % 7 = 0 THEN ele - 30 ELSE ele END, 6) AS ele,
        CAST(place AS INT) AS segment, CAST(place AS INT) AS phys, CASE WHEN ele IS NULL THEN 'none' ELSE 'gpx' END AS ele_source, CASE WHEN seq % 7 = 0 THEN 'ellipsoid' ELSE 'unknown' END AS datum,
        CASE WHEN seq % 7 = 0 AND ele IS NOT NULL THEN 30e0 END AS geoid_m,
        CASE WHEN seq % 7 = 0 THEN '<x:datum xmlns:x="urn:x"><elevationDatum>ellipsoid</elevationDatum></x:datum> <n>&lt;</n>' ELSE '' END AS fragments FROM placed"""


def _towards(a: str, b: str) -> str:
    d = f"radians({b}lon - {a}lon)"
    turned = f"degrees(atan2(sin({d}) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos({d})))"
    return f"(CASE WHEN {turned} < 0 THEN {turned} + 360 ELSE {turned} END)"


ORACLE_SQL["sql_functions"] = f"""WITH {DENSE}, near AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
    turns AS (SELECT track_id, seq, {dist("p_", "")} AS metres, p_lat, {_towards("p_", "")} AS bearing, {_towards("", "n_")} AS onward FROM near)
    SELECT track_id, seq, round(CASE WHEN p_lat IS NOT NULL THEN metres END, 6) AS metres, round(bearing, 6) AS bearing,
        round(CASE WHEN abs(bearing - onward) > 180 THEN 360 - abs(bearing - onward) ELSE abs(bearing - onward) END, 6) AS turned FROM turns"""


#: What the query explicit_profiles asks for, by track.
_ASKED = "(['slow', 'fast', ' ', 'unrestricted', 'sprint', NULL])[track_id % 6 + 1]"
_KNOWN = "('slow', 'moderate', 'fast', 'unrestricted', 'unknown')"
ORACLE_SQL["explicit_profiles"] = f"""WITH {DENSE}, {PAIRS}, {GAPS}, {ROUTE}, {SPEED}, {RELIABLE}, {MOTION},
    tracks AS (SELECT DISTINCT track_id, {_ASKED} AS asked, (['moderate', NULL, 'unknown', 'nonsense'])[track_id % 4 + 1] AS wanted FROM pts),
    judged AS (SELECT t.track_id, wanted, CASE WHEN trim(asked) <> '' THEN CASE WHEN asked IN {_KNOWN} THEN asked ELSE 'unknown' END ELSE coalesce(m.profile, 'unknown') END AS profile,
        CASE WHEN trim(asked) <> '' THEN 'explicit' WHEN m.profile <> 'unknown' THEN 'inferred' ELSE 'default' END AS profile_source FROM tracks t LEFT JOIN motion m USING (track_id)),
    limits AS (SELECT j.track_id, j.profile, profile_source, CASE WHEN j.profile <> 'unknown' THEN 'high' ELSE 'low' END AS confidence,
        CASE j.profile WHEN 'slow' THEN 6e0 WHEN 'moderate' THEN 10e0 WHEN 'fast' THEN 25e0 ELSE 50e0 END AS ceiling_mps,
        CASE WHEN wanted IN {_KNOWN} THEN wanted WHEN c.profile = 'slow' AND j.profile <> 'slow' THEN 'slow' WHEN c.profile = 'moderate' AND j.profile NOT IN ('slow', 'moderate') THEN 'moderate' ELSE j.profile END AS reliability_profile
        FROM judged j JOIN ceilings c ON j.track_id = c.track_id),
    tops AS (SELECT *, CASE reliability_profile WHEN 'slow' THEN 21.6e0 WHEN 'moderate' THEN 36e0 WHEN 'fast' THEN 90e0 END AS ceiling_kmh FROM limits)
    SELECT t.*, (SELECT count(*) FROM speeds s WHERE s.track_id = t.track_id AND kmh > ceiling_kmh) AS n_outliers FROM tops t"""

_SINKING = DENSE.replace("CASE WHEN e % 61 <> 0 THEN 100 + value / 50 + CASE WHEN e % 37 = 0 THEN 80e0 ELSE 0e0 END END AS ele",
    "CASE WHEN e % 61 = 0 THEN NULL WHEN track_id % 3 = 0 THEN 900 - seq * 2e0 WHEN track_id % 3 = 1 THEN 900 - seq * 2e0 + seq % 2 * 20 ELSE 100e0 END AS ele")
ORACLE_SQL["activity_candidates"] = f"""WITH {_SINKING}, {PAIRS}, {GAPS}, act AS ({ACTIVITY}), m AS (SELECT *, coalesce(median_kmh, 0) AS med, coalesce(p95_kmh, median_kmh, 0) AS top FROM act),
    options AS (SELECT track_id, 0 AS o, activity, confidence AS score, reason FROM m
        UNION ALL SELECT track_id, 1, 'foot', CASE WHEN activity = 'bike' THEN 0.48e0 ELSE 0.35e0 END, 'fallback_slow_motion' FROM m WHERE activity <> 'foot' AND med > 0
        UNION ALL SELECT track_id, 2, 'bike', CASE WHEN activity = 'foot' THEN 0.48e0 ELSE 0.4e0 END, 'near_bike_speed' FROM m WHERE activity <> 'bike' AND (med >= 6 OR top >= 16)
        UNION ALL SELECT track_id, 3, 'water', 0.42e0, 'sustained_descent' FROM m WHERE activity <> 'water' AND net_ele < -80
        UNION ALL SELECT track_id, 4, 'water', CASE WHEN activity = 'foot' THEN 0.42e0 ELSE 0.35e0 END, 'flat_low_speed' FROM m WHERE activity <> 'water' AND n_timed >= 6 AND med > 0 AND med <= 8 AND top <= 18
            AND abs(net_ele) <= 20 AND (raw_ele <= 40 OR directional <= 0.5))
    SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY score DESC, o) AS INT) AS rank, activity, score, reason FROM options"""
