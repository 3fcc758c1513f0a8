"""What attachments hold: true types by content, members of archives, and features of documents.

Containers are opened inside the worker that has their bytes, each to a flat list of rows with a parent, within budgets
that bound memory: an archive that would unpack to more gives the members so far and an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lurescope.runtime import ship
from lurescope.sources.markup import page_features

#: Nesting, members of an archive, files of a message, bytes of a member, and bytes unpacked at most.
DEPTH, MEMBERS, FILES, MEMBER_BYTES, UNPACKED_BYTES = 3, 200, 400, 25 << 20, 256 << 20

_MAGIC = (
    (b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "ole"), (b"Rar!\x1a\x07", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"MZ", "pe"), (b"\x7fELF", "elf"),
    (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"\x1f\x8b", "gzip"), (b"{\\rt", "rtf"), (b"L\x00\x00\x00\x01\x14\x02\x00", "lnk"),
    (b"\xe4\x52\x5c\x7b\x8c\xd8\xa7\x4d", "onenote"), (b"MSCF", "cab"), (b"\x78\x9f\x3e\x22", "tnef"), (b"vhdxfile", "vhd"), (b"conectix", "vhd"),
)
FOUND = "file_no int, parent_no int, filename string, size long, sha256 string, true_type string, kind string, encrypted boolean, features array<string>, error string"


def sniff(data: bytes) -> str:
    """The type that the content says, empty if none is known."""
    for magic, kind in _MAGIC:
        if data.startswith(magic):
            return kind
    if data[0x8001:0x8006] == b"CD001":
        return "iso"
    if data[257:262] == b"ustar":
        return "tar"
    head = data[:2048].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if head.startswith(b"begin:vcalendar"):
        return "calendar"
    if re.match(rb"(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*|<!doctype svg[^>]*>\s*)*<svg\b", head, re.S):
        return "svg"
    return "html" if re.match(rb"(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body|script|meta|form)\b", head, re.S) else ""


def _zip_members(data: bytes) -> Iterator[tuple[str, bytes | None, bool]]:
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        for info in [i for i in held.infolist() if not i.is_dir()][:MEMBERS]:
            locked = bool(info.flag_bits & 1)
            body = None
            if not locked and info.file_size <= MEMBER_BYTES:
                with held.open(info) as member:
                    body = member.read(MEMBER_BYTES + 1)
            yield info.filename, body if body is not None and len(body) <= MEMBER_BYTES else None, locked


def _tar_members(data: bytes) -> Iterator[tuple[str, bytes | None, bool]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as held:
        for number, info in enumerate(i for i in held if i.isfile()):
            if number >= MEMBERS:
                return
            yield info.name, held.extractfile(info).read() if info.size <= MEMBER_BYTES else None, False


def _gzip_member(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, bool]]:
    with gzip.open(io.BytesIO(data)) as held:
        body = held.read(2 * MEMBER_BYTES + 1)
    bare = re.sub(r"(?i)\.tgz$", ".tar", name) if name.lower().endswith(".tgz") else re.sub(r"(?i)\.gz$", "", name)
    yield bare, body if len(body) <= 2 * MEMBER_BYTES else None, False


def office_features(data: bytes) -> list[str]:
    """What an OOXML document carries: macros, links that load by themselves, embedded files."""
    found = set()
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        names = [n.lower() for n in held.namelist()]
        if "[content_types].xml" not in names:
            return []
        for pattern, feature in ((r"vbaproject\.bin$", "vba-macro"), (r"/macrosheets/", "xlm-macro"), (r"/activex/", "activex"), (r"/embeddings/.*\.bin$", "embedded-object")):
            if any(re.search(pattern, n) for n in names):
                found.add(feature)
        for info in held.infolist():
            if info.filename.lower().endswith(".rels") and info.file_size <= 1 << 20:
                for tag in re.findall(r"<Relationship\b[^>]*>", held.read(info).decode("utf-8", "replace")):
                    kind = re.search(r'Type="[^"]*/(\w+)"', tag)
                    if kind and 'TargetMode="External"' in tag:
                        name = kind[1].lower()
                        if name in ("attachedtemplate", "oleobject", "frame", "subdocument"):
                            found.add(f"remote-{name}")
                        if re.search(r'Target="(?:ms-|mhtml:|search-ms)', tag):
                            found.add("protocol-handler")
            elif re.search(r"(?i)word/(?:document|footer|header)\d*\.xml$", info.filename) and info.file_size <= MEMBER_BYTES:
                if re.search(rb">\s*(?:DDEAUTO|DDE)\b", held.read(info)):
                    found.add("dde")
    return sorted(found)


def pdf_features(data: bytes) -> list[str]:
    """Actions and parts that a PDF names, in its plain objects and in deflated streams."""
    parts = [data]
    budget = 20 << 20
    for m in re.finditer(rb"stream\r?\n", data):
        try:
            plain = zlib.decompressobj().decompress(data[m.end() :], budget)
        except zlib.error:
            continue
        parts.append(plain)
        budget -= len(plain)
        if budget <= 0:
            break
    text = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), b"\n".join(parts))
    names = {n.lower() for n in re.findall(rb"/([A-Za-z0-9]+)", text)}
    rules = ((b"launch", "launch"), (b"javascript", "javascript"), (b"js", "javascript"), (b"openaction", "open-action"), (b"aa", "auto-action"), (b"embeddedfile", "embedded-file"), (b"submitform", "submit-form"), (b"xfa", "xfa"), (b"richmedia", "rich-media"), (b"encrypt", "encrypted"))
    return sorted({feature for name, feature in rules if name in names})


def rtf_features(data: bytes) -> list[str]:
    found = set()
    if re.search(rb"\\obj(?:ect|data)\b", data):
        found.add("ole-object")
    if b"\\objupdate" in data:
        found.add("auto-update")
    if re.search(rb"\\\*\\template\s+(?:https?|ftp|\\\\)", data, re.I):
        found.add("remote-template")
    for name in re.findall(rb"\\objclass\s+([A-Za-z0-9.]+)", data):
        found.add("class-" + name.decode().lower())
    return sorted(found)


_FEATURES = {"pdf": pdf_features, "rtf": rtf_features, "html": page_features, "svg": page_features}


def opened(name: str, data: bytes) -> Iterator[dict]:
    """A row for the file and for each file inside it; parent_no is null for the file itself."""
    waiting, number, unpacked = [(name, data, None, 0)], 0, 0
    while waiting and number < FILES:
        name, body, parent, depth = waiting.pop(0)
        kind = sniff(body) if body is not None else ""
        row = {"file_no": number, "parent_no": parent, "filename": name, "size": None if body is None else len(body), "sha256": None if body is None else hashlib.sha256(body).hexdigest(), "true_type": kind, "kind": "", "encrypted": False, "features": [], "error": None}
        try:
            if kind in _FEATURES or re.search(r"(?i)\.(?:html?|shtml|xhtml|svg)$", name):
                row["features"] = _FEATURES.get(kind, page_features)(body or b"")
            if kind in ("zip", "tar", "gzip"):
                row["features"] = office_features(body) if kind == "zip" else []
                row["kind"] = {"zip": "ZIP file", "tar": "tar archive", "gzip": "gzip file"}[kind]
                if depth < DEPTH:
                    members = _zip_members(body) if kind == "zip" else _tar_members(body) if kind == "tar" else _gzip_member(name, body)
                    for inner, content, locked in members:
                        row["encrypted"] |= locked
                        unpacked += len(content or b"")
                        if unpacked > UNPACKED_BYTES:
                            raise ValueError("unpacks to too much")
                        waiting.append((inner, content, number, depth + 1))
        except Exception as problem:  # a broken file is a row
            row["error"] = f"{type(problem).__name__}: {problem}"[:200]
        yield row
        number += 1


def expand(files: DataFrame, key: str = "msg_id", name: str = "filename", content: str = "content") -> DataFrame:
    """key and the rows of ``opened`` for each file. Null names and contents count as empty."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"k {files.schema[key].dataType.simpleString()}, {FOUND}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"k": one["k"]} | row for row in opened(one["n"] or "", one["c"] or b"")], schema=arrow)

    ship(files.sparkSession)
    return files.selectExpr(f"`{key}` AS k", f"`{name}` AS n", f"`{content}` AS c").mapInArrow(run, schema).withColumnRenamed("k", key)
