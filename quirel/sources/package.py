"""ZIP packages and XML parts, with limits on what an archive may make of itself."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote

from .model import ConvertError

#: Decompressed bytes an entry and a package, entries, depth and elements of an XML part.
ENTRY_MAX, TOTAL_MAX, ENTRIES_MAX, DEPTH_MAX, NODES_MAX = 128 << 20, 512 << 20, 100_000, 256, 2_000_000
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Where the URIs of the strict form of office packages begin, and those of the usual form.
STRICT_ROOT, USUAL_ROOT = "http://purl.oclc.org/ooxml/", "http://schemas.openxmlformats.org/"
# What names a format in a main part's content type, and in a manifest's media type.
MAIN_TYPES = {"wordprocessingml": "docx", "ms-word": "docx", "spreadsheetml": "xlsx", "ms-excel": "xlsx", "presentationml": "pptx", "ms-powerpoint": "pptx"}
MEDIA_TYPES = {"opendocument.text": "odt", "opendocument.spreadsheet": "ods", "opendocument.presentation": "odp", "epub+zip": "epub"}


def usual_uri(uri: str) -> str | None:
    """The usual form of a strict URI (family, year of the first edition, rest), or None if it isn't one."""
    family, slash, tail = uri.removeprefix(STRICT_ROOT).partition("/")
    return f"{USUAL_ROOT}{family}/2006/{tail}" if uri.startswith(STRICT_ROOT) and slash else None


def declared_encoding(head: bytes) -> str | None:
    """The encoding that an XML declaration names."""
    m = re.search(rb"encoding\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", head)
    return (m[1] if m[1] is not None else m[2]).decode("ascii", "replace") if m else None


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def attr(e: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if name in e.attrib:
        return e.attrib[name]
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def kid(e: ET.Element | None, *names: str) -> ET.Element | None:
    """The first child along a path of local names."""
    for n in names:
        if e is None:
            return None
        e = next((c for c in e if local(c.tag) == n), None)
    return e


def kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [c for c in e if local(c.tag) in names] if e is not None else []


def all_of(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if local(c.tag) == name]


def parse_xml(data: bytes) -> ET.Element:
    """Element tree of a part; depth and size are counted while reading, entity declarations are refused."""
    if b"<!ENTITY" in data:
        raise ConvertError("malformed", "entity declarations aren't read")
    root, depth, nodes = None, 0, 0
    try:
        for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
            if event == "start":
                root = e if root is None else root
                depth, nodes = depth + 1, nodes + 1
                if depth > DEPTH_MAX or nodes > NODES_MAX:
                    raise ConvertError("resourceLimit", "XML part too deep or too large")
            else:
                depth -= 1
    except ET.ParseError as x:
        raise ConvertError("malformed", f"XML: {x}") from None
    if root is None:
        raise ConvertError("malformed", "XML part without an element")
    return root


class Package:
    def __init__(self, data: bytes):
        if data[:8] == OLE:
            raise ConvertError("encrypted", "an encrypted or legacy container")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as x:
            raise ConvertError("malformed", f"package: {x}") from None
        if len(self.zip.infolist()) > ENTRIES_MAX:
            raise ConvertError("resourceLimit", "too many package entries")
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}
        self.cache: dict[str, bytes] = {}
        self.spent = 0

    def part(self, name: str) -> bytes | None:
        name = name.lstrip("/")
        if name in self.cache:
            return self.cache[name]
        if name not in self.names:
            return None
        try:
            with self.zip.open(self.names[name]) as f:
                data = f.read(ENTRY_MAX + 1)
        except RuntimeError as x:
            raise ConvertError("encrypted", str(x)) from None
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, Exception) as x:  # noqa: BLE001
            raise ConvertError("malformed", f"{name}: {x}") from None
        self.spent += len(data)
        if len(data) > ENTRY_MAX or self.spent > TOTAL_MAX:
            raise ConvertError("resourceLimit", f"{name} is too large")
        self.cache[name] = data
        return data

    def xml(self, name: str) -> ET.Element | None:
        data = self.part(name)
        return parse_xml(data) if data is not None else None

    def optional(self, name: str | None) -> ET.Element | None:
        """A part that may be missing or broken; only limits stop the whole document."""
        if not name:
            return None
        try:
            return self.xml(name)
        except ConvertError as x:
            if x.code == "resourceLimit":
                raise
            return None

    def rels(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Relationship id -> (type's last name, target part or address, external)."""
        folder, name = posixpath.split(part)
        root = self.optional(posixpath.join(folder, "_rels", name + ".rels"))
        out = {}
        for r in root if root is not None else ():
            target, outside = r.get("Target", ""), r.get("TargetMode") == "External"
            kind = r.get("Type", "")
            out[r.get("Id", "")] = ((usual_uri(kind) or kind).rsplit("/", 1)[-1], target if outside else resolve(part, target), outside)
        return out

    def content_type(self, part: str) -> str | None:
        """A part's content type: its own override, else the default of its extension."""
        types = self.optional("[Content_Types].xml")
        if types is None:
            return None
        own = next((e.get("ContentType") for e in kids(types, "Override") if e.get("PartName", "").lower() == f"/{part}".lower()), None)
        ext = part.rsplit(".", 1)[-1].lower() if "." in part else None
        return own or next((e.get("ContentType") for e in kids(types, "Default") if e.get("Extension", "").lower() == ext), None)

    def main_part(self) -> str | None:
        rels = self.rels("")
        return next((t for _, (k, t, _) in sorted(rels.items()) if k == "officeDocument"), None)


def resolve(base: str, ref: str) -> str:
    """A part reference from a part: percent-decoded, without fragment, never above the root."""
    ref = unquote(ref.split("#", 1)[0])
    path = ref if ref.startswith("/") else posixpath.join(posixpath.dirname(base), ref)
    return posixpath.normpath("/" + path).lstrip("/")


def detect(data: bytes) -> str | None:
    """Format by content: rtf, ole kinds, package kinds, pdf; None if unknown."""
    if data[:5] == b"{\\rtf":
        return "rtf"
    if data[:8] == OLE:
        from .ole import Compound

        try:
            names = Compound(data).root_streams()
        except Exception:  # noqa: BLE001 - whatever is broken, it isn't a known container
            return None
        return next((kind for name, kind in (("WordDocument", "doc"), ("PowerPoint Document", "ppt"), ("Workbook", "xls"), ("Book", "xls")) if name in names), None)
    if data[:4] == b"PK\x03\x04":
        try:
            p = Package(data)
            mime = (p.part("mimetype") or b"").decode("latin-1").strip()
            manifest = p.optional("META-INF/manifest.xml")
            if not mime and manifest is not None:
                mime = next((attr(e, "media-type", "") for e in kids(manifest, "file-entry") if attr(e, "full-path") == "/"), "")
            if kind := next((k for name, k in MEDIA_TYPES.items() if name in mime), None):
                return kind
            main = p.main_part()
            root = p.optional(main)
            typed = p.content_type(main) if main else None
            if typed and (kind := next((k for name, k in MAIN_TYPES.items() if name in typed.lower()), None)):
                return kind
            if root is not None:
                return {"document": "docx", "workbook": "xlsx", "presentation": "pptx"}.get(local(root.tag))
            for path, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub"), ("content.xml", "odt")):
                if path in p.names:
                    return kind
        except ConvertError:
            return None
        return None
    return "pdf" if b"%PDF-" in data[:1024] else None
