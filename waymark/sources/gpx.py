"""A pull reader of GPX and like XML: memory is bounded by one point, one extension and the number of segments.

Elements that lay out a file (trk, trkseg, rte, trkpt, rtept, metadata, name) are known by their qualified names as written, so
``g:trkpt`` is no point; what a point or track states (ele, time, type, extensions) is known by local name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

from waymark.sources.parse import FIELD_OF, TRACK_STATS, BadTrack, activity_kind, is_generic, place, point

#: Parts names that expat resolves into namespace, local name and prefix; no XML text holds it.
SEP = "\x1f"
#: What a point states in child elements.
FIELDS = frozenset(("ele", "time", "geoidheight", "fix", "sat", "hdop", "vdop", "pdop"))
#: Bytes handed to expat at once.
CHUNK = 1 << 16
DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
XML = "http://www.w3.org/XML/1998/namespace"


def numeric(text: str | None) -> float | None:
    """A decimal, exponent, 0x, 0o or 0b number, 0 for blank text; null for null, anything else and infinities."""
    if text is None:
        return None
    t = text.strip()
    if DECIMAL.fullmatch(t):
        x = float(t)
        return x if abs(x) < float("inf") else None
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    return None if t else 0.0


def squeezed(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def escaped(text: str, quote: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quote else out


class Fragment:
    """One element written again as a document of its own: namespaces are declared where they are first needed."""

    def __init__(self, targets: list[list[str]]) -> None:
        self.targets, self.parts, self.scopes, self.open, self.cdata = targets, [], [{"": "", "xml": XML}], False, False

    def start(self, prefix: str, local: str, uri: str, attributes: list[tuple[str, str, str, str]], declared: list[tuple[str, str]]) -> None:
        self.content("")
        scope = self.scopes[-1] | dict(declared)
        needed = list(declared)
        for p, u in ((prefix, uri), *((p, u) for p, _, u, _ in attributes if p)):
            if scope.get(p, "") != u:
                scope[p] = u
                needed.append((p, u))
        names = [(f"xmlns:{p}" if p else "xmlns", u) for p, u in needed] + [(f"{p}:{n}" if p else n, v) for p, n, _, v in attributes]
        self.parts.append(f"<{prefix}:{local}" if prefix else f"<{local}")
        self.parts += [f' {n}="{escaped(v, True)}"' for n, v in names]
        self.scopes.append(scope)
        self.open = True

    def end(self, name: str) -> bool:
        self.parts.append("/>" if self.open else f"</{name}>")
        self.open = False
        self.scopes.pop()
        return len(self.scopes) == 1

    def content(self, raw: str) -> None:
        if self.open:
            self.parts.append(">")
            self.open = False
        self.parts.append(raw)


class Node:
    __slots__ = ("serial", "local", "name", "point", "targets", "capture", "collector", "named", "typed")

    def __init__(self, serial: int, local: str, name: str) -> None:
        self.serial, self.local, self.name = serial, local, name
        self.point = self.targets = self.capture = self.collector = self.named = None
        self.typed = False


class Reader:
    """Takes bytes by feed and hands finished points to emit(kind, holder, record); the rest is in header() at the end.
    Coordinates that can't be used are errors of the file, those of trkpt before those of rtept."""

    def __init__(self, emit: Callable[[str, int, dict], None]) -> None:
        self.emit = emit
        self.parser = p = expat.ParserCreate(namespace_separator=SEP)
        p.namespace_prefixes, p.ordered_attributes, p.buffer_text = True, True, True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.declared.append((prefix or "", uri or ""))
        p.CommentHandler = lambda data: self.raw(f"<!--{data}-->")
        p.ProcessingInstructionHandler = lambda target, data: self.raw(f"<?{target} {data}?>")
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = (lambda: self.section(True)), (lambda: self.section(False))
        self.stack: list[Node] = []
        self.declared: list[tuple[str, str]] = []
        self.captures: list[list[str]] = []
        self.collectors: list[list] = []
        self.fragments: list[Fragment] = []
        self.elements = self.inside = 0
        self.raw_extensions: dict[str, list[str]] = {"gpx": [], "metadata": [], "tracks": []}
        self.names: dict[str, list[str] | None] = {}
        self.types: list[tuple[int, str, list[str]]] = []
        self.summary: dict[str, float] = {}
        self.bad: dict[str, str] = {}
        self.holders: dict[str, dict[int, bool]] = {"trkpt": {}, "rtept": {}}

    def feed(self, data: bytes, last: bool = False) -> None:
        try:
            self.parser.Parse(data, last)
        except expat.ExpatError as e:
            raise BadTrack("invalid_xml") from e

    def start(self, tag: str, attrs: list[str]) -> None:
        uri, local, prefix = split(tag)
        name = f"{prefix}:{local}" if prefix else local
        above = self.stack[-1] if self.stack else None
        node = Node(self.elements, local, name)
        self.elements += 1
        declared, self.declared = self.declared, []
        extended = above is not None and above.local == "extensions" and len(self.stack) > 1 and self.stack[-2].targets is not None
        if extended:
            self.fragments.append(Fragment(self.stack[-2].targets))
        listed = None
        if self.fragments or self.collectors:
            listed = [(*split(k), v) for k, v in zip(attrs[::2], attrs[1::2], strict=True)]
            for f in self.fragments:
                f.start(prefix, local, uri, [(p, n, u, v) for u, n, p, v in listed], declared)
        if self.collectors:
            self.capture(node)
            for c in self.collectors:
                c.append((local, uri, listed, node.capture))
        if name == "extensions" and not self.inside:  # its descendants may state a summary
            node.collector = []
            self.collectors.append(node.collector)
        if local == "extensions":
            self.inside += 1
            if above is not None and above.point is not None and node.collector is None:
                node.collector = []
                self.collectors.append(node.collector)
        if above is None:
            node.targets = [self.raw_extensions["gpx"]]
        if name in ("metadata", "trk"):
            node.targets = (node.targets or []) + [self.raw_extensions["metadata" if name == "metadata" else "tracks"]]
            if name not in self.names:
                self.names[name], node.named = None, name
        elif name in ("trkpt", "rtept"):
            self.point(node, above, attrs)
        elif name == "name":
            for n in self.stack:
                if n.named and self.names[n.named] is None:
                    self.names[n.named] = self.capture(node)
        if above is not None:
            if above.point is not None and local in FIELDS and local not in above.point["texts"]:
                above.point["texts"][local] = self.capture(node)
            elif local == "type" and above.name in ("trk", "rte") and not above.typed:
                above.typed = True
                self.types.append((above.serial, above.name, self.capture(node)))
        self.stack.append(node)

    def point(self, node: Node, above: Node | None, attrs: list[str]) -> None:
        given = dict(zip(attrs[::2], attrs[1::2], strict=True))
        holder = (above or node).serial
        self.holders[node.name].setdefault(holder, above is not None and above.name == {"trkpt": "trkseg", "rtept": "rte"}[node.name])
        try:
            at = place(numeric(given.get("lat")), numeric(given.get("lon")))
        except BadTrack as e:
            self.bad.setdefault(node.name, str(e))
            at = (0.0, 0.0)
        node.point = {"at": at, "holder": holder, "texts": {}, "extensions": [], "marks": []}
        node.targets = (node.targets or []) + [node.point["extensions"]]

    def capture(self, node: Node) -> list[str]:
        if node.capture is None:
            node.capture = []
            self.captures.append(node.capture)
        return node.capture

    def text(self, data: str) -> None:
        for c in self.captures:
            c.append(data)
        for f in self.fragments:
            f.content(data if f.cdata else escaped(data))

    def raw(self, data: str) -> None:
        for f in self.fragments:
            f.content(data)

    def section(self, begins: bool) -> None:
        for f in self.fragments:
            f.content("<![CDATA[" if begins else "]]>")
            f.cdata = begins

    def end(self, tag: str) -> None:
        node = self.stack.pop()
        if node.capture is not None:
            self.captures.pop()
        for f in self.fragments:
            if f.end(node.name):
                for t in f.targets:
                    t.append("".join(f.parts))
        if self.fragments and len(self.fragments[-1].scopes) == 1:
            self.fragments.pop()
        if node.local == "extensions":
            self.inside -= 1
        if node.collector is not None:
            self.collectors.pop()
            if node.name == "extensions" and not self.inside:
                self.summarise(node.collector)
            if self.stack and self.stack[-1].point is not None:
                self.stack[-1].point["marks"] += [(squeezed(local), "".join(text).strip().lower()) for local, _, _, text in node.collector]
        if node.point is not None:
            self.emit(node.name, node.point["holder"], record(node.point))

    def summarise(self, stated: list) -> None:
        for local, uri, attributes, text in stated:
            for space, key, value in ((uri, local, "".join(text)), *((u, n, v) for u, n, _, v in attributes)):
                own = squeezed(key)
                field, x = FIELD_OF.get(own), None
                if field is not None and field not in self.summary and (x := numeric(value)) is not None:
                    self.summary[field] = x * 3.6 if space == TRACK_STATS and own in ("movingspeed", "maxspeed") else x

    def header(self) -> dict:
        """name, activity, activity_source, summary and raw_extensions; an error that the points have is raised."""
        if self.bad:
            raise BadTrack(self.bad.get("trkpt") or self.bad["rtept"])
        texts = {k: "".join(v or []) for k, v in self.names.items()}
        name = (texts.get("trk") or texts.get("metadata") or "").strip()
        kinds = [(raw, tag) for want in ("trk", "rte") for _, tag, text in sorted(self.types) if tag == want and activity_kind(raw := "".join(text).strip())]
        activity, tag = kinds[0] if kinds else (None, None)
        return {
            "summary": self.summary, "name": name if name and not is_generic(name) else None, "activity": activity, "timer": [],
            "activity_source": {"trk": "gpx_track_type", "rte": "gpx_route_type", None: None}[tag], "extensions": self.raw_extensions,
        }

    def places(self) -> tuple[dict[int, int], dict[int, int]]:
        """Segment and physical number of the elements that hold points: trksegs, then routes in order of the document."""
        ordered = [h for kind in ("trkpt", "rtept") for h in sorted(k for k, container in self.holders[kind].items() if container)]
        physical = dict.fromkeys(h for kind in ("trkpt", "rtept") for h in self.holders[kind])
        return {h: k for k, h in enumerate(ordered)}, {h: k for k, h in enumerate(physical)}


def split(tag: str) -> tuple[str, str, str]:
    """Namespace, local name and prefix, empty where there is none."""
    parts = tag.split(SEP)
    return ("", parts[0], "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")


def record(stated: dict) -> dict:
    """A point's record. An ellipsoid's height less that of the geoid is one above the sea; geoid_m is what was taken off."""
    texts = {k: "".join(v).strip() or None for k, v in stated["texts"].items()}
    value = lambda k: numeric(texts.get(k))
    ele, geoid, sat = value("ele"), value("geoidheight"), value("sat")
    source = "barometric" if any(k in ("elevationsource", "altitudesource") and v == "barometric" for k, v in stated["marks"]) else None
    datum = next((v for k, v in stated["marks"] if k in ("elevationdatum", "heightreference") and v in ("ellipsoid", "msl")), "unknown")
    lowered = ele is not None and geoid is not None and datum == "ellipsoid"
    return point(
        *stated["at"], ele - geoid if lowered else ele, texts.get("time"), 0, source, fix=texts.get("fix"), satellites=None if sat is None else int(sat),
        datum=datum, geoid_m=geoid if lowered else None, extensions=stated["extensions"], **{k: value(k) for k in ("hdop", "vdop", "pdop")},
    )


def chunks(data: bytes) -> Iterator[bytes]:
    return (data[k : k + CHUNK] for k in range(0, len(data), CHUNK))


def run(reader: Reader, parts: Iterable[bytes]) -> Iterator[None]:
    """Feeds the parts, with a stop after each, in which what was emitted can be taken."""
    first = True
    for part in parts:
        if first and (head := part.removeprefix(b"\xef\xbb\xbf").lstrip()) and head[:1] != b"<" and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            raise BadTrack("not_xml")
        first = False
        reader.feed(part)
        yield
    reader.feed(b"", True)
    yield


def gpx(data: bytes) -> dict:
    """A file's record with all points: every trkpt in order, then every rtept. A trkseg that holds points is a segment, then
    each such rte; points elsewhere are in segment 0. phys tells the elements apart that hold points."""
    found: dict[str, list] = {"trkpt": [], "rtept": []}
    reader = Reader(lambda kind, holder, row: found[kind].append((holder, row)))
    for _ in run(reader, chunks(data)):
        pass
    header = reader.header()
    segments, physical = reader.places()
    return header | {"points": [row | {"segment": segments.get(h, 0), "phys": physical[h]} for rows in found.values() for h, row in rows]}


def stream(opened: Callable[[], Iterable[bytes]]) -> Iterator[dict]:
    """gpx's points one by one, in memory that doesn't grow with the file, which is read twice (three times if it has routes):
    a first pass numbers the segments and finds what is wrong, so that a bad file gives no points."""
    reader = Reader(lambda kind, holder, row: None)
    for _ in run(reader, opened()):
        for kept in reader.raw_extensions.values():
            kept.clear()
    reader.header()
    segments, physical = reader.places()
    for want in ("trkpt", "rtept"):
        if reader.holders[want]:
            ready: list[dict] = []
            again = Reader(lambda kind, holder, row, want=want, ready=ready: kind == want and ready.append(row | {"segment": segments.get(holder, 0), "phys": physical[holder]}))
            for _ in run(again, opened()):
                for kept in again.raw_extensions.values():
                    kept.clear()
                again.types.clear()
                yield from ready
                ready.clear()
