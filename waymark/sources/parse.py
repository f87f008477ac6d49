"""Bytes of one GPX, TCX or FIT file to plain records, for use inside tasks."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

#: Normalised names of summary elements in extensions, by the field that they fill.
SUMMARY_NAMES = {
    "total_distance_m": ["distancemeters", "distance", "totaldistance", "totaldistancemeters"],
    "total_distance_3d_m": ["distance3dmeters", "totaldistance3d", "totaldistance3dmeters", "threedistance", "threedistancemeters"],
    "total_s": ["durationseconds", "timerseconds", "totaltime", "totaldurationseconds", "timertime", "totalelapsedtime"],
    "moving_s": ["movingdurationseconds", "movingseconds", "movingtime", "movingduration"],
    "stopped_s": ["stoppeddurationseconds", "stoppedseconds", "stoppedtime", "stoppedduration", "stoptime", "pausetime"],
    "average_kmh": ["averagespeedkmh", "avgspeedkmh"],
    "moving_kmh": ["movingaveragespeedkmh", "movingavgspeedkmh", "movingspeed"],
    "max_kmh": ["maxspeedkmh", "maxspeed", "maximumspeedkmh", "topspeedkmh"],
    "gain_m": ["ascent", "ascentmeters", "totalascent", "elevationgain", "gain", "elevationgainmeters"],
    "loss_m": ["descent", "descentmeters", "totaldescent", "elevationloss", "loss", "elevationlossmeters"],
    "min_ele": ["minelevation", "minelevationmeters", "minheightmeters", "minaltitudemeters", "minimumaltitude", "minimumelevation"],
    "max_ele": ["maxelevation", "maxelevationmeters", "maxheightmeters", "maxaltitudemeters", "maximumaltitude", "maximumelevation"],
    "range_m": ["elevationrangemeters", "altituderangemeters", "heightrangemeters", "elevationrange", "altituderange", "heightrange"],
}
FIELD_OF = {name: field for field, names in SUMMARY_NAMES.items() for name in names}
#: Names of activities, by kind.
ACTIVITY_NAMES = {
    "bike": ["cycling", "biking", "bike", "road_cycling", "mountain_biking"],
    "foot": ["running", "walking", "hiking", "walk", "run"],
    "water": ["kayaking", "canoeing", "rowing", "swimming"],
    "motor": ["driving", "motorcycling", "automobile"],
}
KIND_OF = {name: kind for kind, names in ACTIVITY_NAMES.items() for name in names}
#: Names that say nothing, in five languages, without accents: those that count alone, and those that also
#: count with a number or date after them.
GENERIC_ALONE = [
    "track", "route", "activity", "workout", "untitled", "untitled track", "untitled route", "untitled activity", "new track", "new route", "new activity",
    "трек", "маршрут", "активность", "тренировка", "без названия", "безымянный трек", "новый трек", "новый маршрут", "новая активность",
    "sin titulo", "sin nombre", "ruta", "actividad", "entrenamiento", "ruta sin titulo", "nueva ruta", "nueva actividad",
    "sans titre", "trace", "activite", "parcours", "itineraire", "trace sans titre", "nouvelle trace", "nouvel itineraire",
    "unbenannt", "track ohne titel", "strecke", "aktivitat", "training", "neuer track", "neue strecke",
]
GENERIC_NUMBERED = [
    "current track", "current activity", "current route", "текущий трек", "текущая активность", "текущий маршрут", "actividad actual", "track actual", "ruta actual",
    "activite actuelle", "trace actuelle", "itineraire actuel", "aktuelle aktivitat", "aktueller track", "aktuelle route", "aktuelle strecke",
    "track", "activity", "workout", "untitled", "untitled track", "untitled activity", "new track", "new activity",
    "трек", "активность", "тренировка", "без названия", "безымянный трек", "новый трек", "новая активность",
    "sin titulo", "sin nombre", "actividad", "entrenamiento", "ruta sin titulo", "nueva actividad", "sans titre", "trace sans titre", "nouvelle trace",
    "unbenannt", "track ohne titel", "aktivitat", "training", "neuer track",
]
#: Namespaces of extensions that have rules of their own.
TRACK_STATS = "http://www.garmin.com/xmlschemas/TrackStatsExtension/v1"
SENSORS = "http://www.garmin.com/xmlschemas/ActivityExtension/v2"


#: Raw extensions of a file that has none.
NO_EXTENSIONS: dict[str, list[str]] = {"gpx": [], "metadata": [], "tracks": []}


class BadTrack(ValueError):
    """A file that can't be read as a track; the message is the error's code."""


def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def child_text(element: ET.Element, name: str) -> str | None:
    return next((c.text for c in element if local(c).lower() == name), None)


def number(text: str | None) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def place(lat: float | None, lon: float | None) -> tuple[float, float]:
    if lat is None or lon is None:
        raise BadTrack("missing_coordinates")
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise BadTrack("coordinates_out_of_bounds")
    return lat, lon


def activity_kind(raw: str | None) -> str | None:
    """bike, foot, water or motor for a known name of an activity."""
    return KIND_OF.get(re.sub(r"[\s-]+", "_", raw.strip().lower())) if raw else None


def plain(name: str) -> str:
    letters = unicodedata.normalize("NFD", name.strip().lower())
    return re.sub(r"\s+", " ", "".join(c for c in letters if not "\u0300" <= c <= "\u036f"))


ALONE, NUMBERED = ({plain(n) for n in names} for names in (GENERIC_ALONE, GENERIC_NUMBERED))


def is_generic(name: str) -> bool:
    """Whether a name says nothing: one of the list, alone or, for some, with a number after it."""
    own = plain(name)
    return own in ALONE or any(own.startswith(p) and re.match(r"(?:[:\-.#–—]\s*)?\d|$", own[len(p) :].lstrip()) for p in NUMBERED)


def stem(path: str) -> str:
    return re.sub(r"\.[^.]+$", "", path.rpartition("/")[2])


def xml_root(data: bytes) -> ET.Element:
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise BadTrack("invalid_xml") from e


def point(lat, lon, ele=None, time=None, segment=0, source=None, **more) -> dict:
    return {"lat": lat, "lon": lon, "ele": ele, "time_text": time, "segment": segment, "phys": segment, "ele_source": source or ("gpx" if ele is not None else "none")} | more


def tcx(data: bytes) -> dict:
    root = xml_root(data)
    points, laps = [], [e for e in root.iter() if local(e) == "Lap"]
    parent = {c: p for p in root.iter() for c in p}
    for k, lap in enumerate(laps):
        for e in (x for x in lap.iter() if local(x) == "Trackpoint"):
            where = next((c for c in e if local(c) == "Position"), None)
            lat, lon = (None, None) if where is None else (number(child_text(where, "latitudedegrees")), number(child_text(where, "longitudedegrees")))
            tpx = [x for x in e.iter() if x.tag == "{" + SENSORS + "}TPX"]
            sensors = {n: next((v for t in tpx for x in t.iter() if local(x) == tag if (v := number(x.text)) is not None), None) for n, tag in (("speed_mps", "Speed"), ("cadence", "RunCadence"), ("watts", "Watts"))}
            points.append(point(*place(lat, lon), number(child_text(e, "altitudemeters")), child_text(e, "time"), k, **sensors))
    totals = {f: [v for lap in laps if (v := number(child_text(lap, n))) is not None] for f, n in (("total_distance_m", "distancemeters"), ("total_s", "totaltimeseconds"), ("calories", "calories"))}
    summary = {f: sum(v) for f, v in totals.items() if v}
    if top := [v for lap in laps if (v := number(child_text(lap, "maximumspeed"))) is not None]:
        summary["max_kmh"] = max(top) * 3.6
    if "total_s" in summary:
        summary["moving_s"] = summary["total_s"]
    sport = None
    for e in (x for x in root.iter() if local(x) == "Trackpoint"):
        while e is not None and local(e) != "Activity":
            e = parent.get(e)
        if e is not None and (sport := e.get("Sport")):
            break
    return {"points": points, "summary": summary, "name": None, "activity": sport, "activity_source": sport and "tcx_activity_sport", "timer": []}


#: FIT base types (size, struct code, invalid value), and seconds from 1970 to the format's epoch.
FIT_TYPES = {0: (1, "B", 0xFF), 1: (1, "b", 0x7F), 2: (1, "B", 0xFF), 3: (2, "h", 0x7FFF), 4: (2, "H", 0xFFFF), 5: (4, "i", 0x7FFFFFFF), 6: (4, "I", 0xFFFFFFFF), 7: (1, "s", None), 8: (4, "f", None), 9: (8, "d", None), 10: (1, "B", 0), 11: (2, "H", 0), 12: (4, "I", 0), 13: (1, "B", 0xFF), 14: (8, "q", None), 15: (8, "Q", None), 16: (8, "Q", 0)}
FIT_EPOCH = 631065600
#: FIT messages and of each the fields that are read, with scale and offset.
FIT_FIELDS = {
    20: {253: ("time", 1, 0), 0: ("lat", 1, 0), 1: ("lon", 1, 0), 2: ("altitude", 5, 500), 78: ("enhanced_altitude", 5, 500)},
    18: {5: ("sport", 1, 0), 6: ("sub_sport", 1, 0), 9: ("total_distance_m", 100, 0), 7: ("total_s", 1000, 0), 8: ("moving_s", 1000, 0), 14: ("average_mps", 1000, 0), 15: ("max_mps", 1000, 0), 22: ("gain_m", 1, 0), 23: ("loss_m", 1, 0)},
    21: {253: ("time", 1, 0), 0: ("event", 1, 0), 1: ("event_type", 1, 0)},
    19: {2: ("start", 1, 0)},
}
#: FIT codes of sports that the activity names know.
FIT_SPORTS = {1: "running", 2: "cycling", 5: "swimming", 11: "walking", 15: "rowing", 17: "hiking", 22: "motorcycling", 24: "driving", 41: "kayaking"}
FIT_ACTIONS = {0: "start", 1: "stop", 4: "stop", 8: "stop", 9: "stop"}


def fit_messages(data: bytes) -> Iterator[tuple[int, dict]]:
    if len(data) < 14 or data[8:12] != b".FIT":
        raise BadTrack("parse_error")
    at, end, formats, clock = data[0], data[0] + struct.unpack("<I", data[4:8])[0], {}, None
    try:
        while at < min(end, len(data)):
            head = data[at]
            at += 1
            if head & 0x80 == 0 and head & 0x40:
                order, number_, n = "<>"[data[at + 1] & 1], 0, data[at + 4]
                number_ = struct.unpack(order + "H", data[at + 2 : at + 4])[0]
                fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
                at += 5 + 3 * n
                extra = 0
                if head & 0x20:
                    extra = sum(data[at + 2 + 3 * k] for k in range(data[at]))
                    at += 1 + 3 * data[at]
                formats[head & 15] = (order, number_, fields, extra)
                continue
            order, number_, fields, extra = formats[head >> 5 & 3 if head & 0x80 else head & 15]
            known, out = FIT_FIELDS.get(number_, {}), {}
            for field, size, kind in fields:
                width, code, invalid = FIT_TYPES.get(kind & 31, (1, "B", None))
                if field in known and code != "s" and size == width:
                    value = struct.unpack(order + code, data[at : at + size])[0]
                    if value != invalid:
                        name, scale, offset = known[field]
                        out[name] = value / scale - offset if scale != 1 or offset else value
                at += size
            at += extra
            if head & 0x80 and clock is not None:
                out["time"] = clock + ((head & 31) - (clock & 31) & 31)
            clock = out.get("time", clock)
            yield number_, out
    except (IndexError, KeyError, struct.error) as e:
        raise BadTrack("parse_error") from e


def degrees(value: float | None, most: float) -> float | None:
    return value if value is None or abs(value) <= most else value * 180 / 2**31


def fit(data: bytes) -> dict:
    points, summary, timer, laps, sport, source = [], {}, [], [], None, None
    for kind, m in fit_messages(data):
        when = m["time"] + FIT_EPOCH if "time" in m else None
        if kind == 20:
            lat, lon = place(degrees(m.get("lat"), 90), degrees(m.get("lon"), 180))
            points.append(point(lat, lon, m.get("enhanced_altitude", m.get("altitude")), None, 0, None, ts_ms=None if when is None else when * 1000))
        elif kind == 18 and not summary:
            which = "sport" if "sport" in m else "sub_sport"
            sport = FIT_SPORTS.get(m[which], str(m[which])) if which == "sport" and which in m else str(m[which]) if which in m else None
            source = f"fit_session_{which}" if sport else None
            summary = {k: float(m[k]) for k in ("total_distance_m", "total_s", "moving_s", "gain_m", "loss_m") if k in m}
            summary |= {k: m[s] * 3.6 for k, s in (("average_kmh", "average_mps"), ("max_kmh", "max_mps")) if s in m}
        elif kind == 21 and m.get("event") == 0 and m.get("event_type") in FIT_ACTIONS and when is not None:
            timer.append({"ts_ms": when * 1000, "action": FIT_ACTIONS[m["event_type"]]})
        elif kind == 19 and "start" in m:
            laps.append((m["start"] + FIT_EPOCH) * 1000)
    times = [p["ts_ms"] for p in points if p["ts_ms"] is not None]
    if times:
        stopped, breaks = False, sorted(laps)[1:]
        for e in sorted(timer, key=lambda e: e["ts_ms"]):
            if e["action"] == "start" and stopped:
                breaks.append(e["ts_ms"])
            stopped = e["action"] == "stop"
        inside = [b for b in breaks if times[0] <= b <= times[-1]]
        firsts = set()
        for b in inside:
            k = next(k for k, p in enumerate(points) if p["ts_ms"] is not None and p["ts_ms"] >= b)
            while k and points[k - 1]["ts_ms"] is None:  # records without a time belong to what follows
                k -= 1
            firsts.add(k)
        firsts -= {0}
        segment = 0
        for k, p in enumerate(points):
            segment += k in firsts
            p["segment"] = p["phys"] = segment
    return {"points": points, "summary": summary, "name": None, "activity": sport, "activity_source": source, "timer": timer}


def route(path: str, media: str = "") -> str | None:
    """The format that a file's extension names, else its media type."""
    kind = {"gpx": "gpx", "xml": "gpx", "tcx": "tcx", "fit": "fit"}.get(path.rpartition(".")[2].lower())
    return kind or next((f for word, f in (("gpx", "gpx"), ("tcx", "tcx"), ("fit", "fit"), ("xml", "gpx")) if word in media.lower()), None)


def parse(path: str, data: bytes, media: str = "") -> dict:
    """A file's record, or one with an error and no points."""
    from waymark.sources.gpx import gpx

    kind = route(path, media)
    empty = {"points": [], "summary": {}, "name": None, "activity": None, "activity_source": None, "activity_kind": None, "timer": [], "extensions": NO_EXTENSIONS}
    if kind is None:
        return empty | {"format": None, "error": "unsupported_format"}
    try:
        found = {"gpx": gpx, "tcx": tcx, "fit": fit}[kind](data)
        return {"extensions": NO_EXTENSIONS} | found | {"format": kind, "error": None, "name": found["name"] or stem(path), "activity_kind": activity_kind(found["activity"])}
    except BadTrack as e:
        return empty | {"format": kind, "error": str(e)}
