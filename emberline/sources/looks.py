"""Short looks into files, read as a stream of pieces: the head for a preview, the rest only to be counted or checked.

A file's content is either in a column or is read by its path in the task, a piece at a time, so a
file of any size takes the memory of its head and of one piece (JSON: of its longest text).
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame

#: Bytes that are looked at for a preview, and sizes of previews.
HEAD_BYTES, PREVIEW_LINES, PREVIEW_CHARS, CSV_ROWS = 2_000_000, 20, 500, 5
PIECE_BYTES = 1 << 20
LOOK = (
    "path string, category string, encoding string, preview string, preview_truncated boolean, lines long, columns array<string>, preview_rows array<array<string>>, "
    "json_valid boolean, json_type string, json_keys array<string>, json_length long, xml_valid boolean, root_tag string, error string"
)
FIELDS = [part.split()[0] for part in LOOK.split(", ")]


def decoded(head: bytes, whole: bool = True) -> tuple[str, str]:
    """The text and its encoding, the first of three that fits. Of a head that is not the whole file the last character may be unfinished."""
    for encoding in ("utf-8", "utf-16", "cp1252"):
        try:
            return codecs.getincrementaldecoder(encoding)().decode(head, whole), encoding
        except UnicodeError:
            continue
    return head.decode("utf-8", errors="replace"), "unknown (best-effort decode)"


class JsonLook:
    """Checks JSON that comes in pieces, and notes the keys of an object or the length of an array at its top."""

    TOKEN = re.compile(
        r"""[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))"""
    )
    REST = re.compile(r"[ \t\n\r]*\Z")
    #: Characters at the end of a piece that may belong to a longer number or word.
    BACK = 400

    def __init__(self):
        self.text, self.open, self.wanted = "", [], "value"
        self.valid, self.kind, self.keys, self.length = True, None, set(), 0

    def feed(self, text: str, final: bool = False) -> None:
        self.text += text
        at, end = 0, len(self.text) - (0 if final else self.BACK)
        while self.valid and at < end:
            found = self.TOKEN.match(self.text, at)
            if not found:
                # a text or a number may go on in the next piece
                self.valid = not final or bool(self.REST.match(self.text, at))
                break
            if not final and found.end() == len(self.text):
                break
            self._token(*found.groups())
            at = found.end()
        self.text = self.text[at:]
        if final:
            self.valid = self.valid and self.wanted == "nothing" and bool(self.REST.match(self.text))

    def _token(self, mark: str | None, text: str | None, other: str | None) -> None:
        wanted = self.wanted
        if mark in ("]", "}"):
            self.valid = bool(self.open) and self.open[-1] == mark and wanted in ("more", "first key" if mark == "}" else "first value")
            if self.valid:
                self.open.pop()
                self.wanted = "more" if self.open else "nothing"
        elif mark == ",":
            self.valid = wanted == "more"
            self.wanted = "key" if self.valid and self.open[-1] == "}" else "value"
        elif mark == ":":
            self.valid, self.wanted = wanted == "colon", "value"
        elif wanted in ("key", "first key"):
            self.valid, self.wanted = text is not None, "colon"
            if text is not None and len(self.open) == 1:
                self.keys.add(text)
        else:
            self.valid = wanted in ("value", "first value")
            self._value(mark, text, other)

    def _value(self, mark: str | None, text: str | None, other: str | None) -> None:
        if not self.open:
            self.kind = {"{": "object", "[": "array"}.get(mark, "scalar")
        elif len(self.open) == 1 and self.open[0] == "]":
            self.length += 1
        if mark:
            self.open.append("}" if mark == "{" else "]")
            self.wanted = "first key" if mark == "{" else "first value"
        else:
            self.wanted = "more" if self.open else "nothing"


def _json(head: bytes, rest: Iterable[bytes], out: dict) -> None:
    look, decoder = JsonLook(), codecs.getincrementaldecoder("utf-8")(errors="replace")
    for piece in _all(head, rest):
        if not look.valid:
            break
        look.feed(decoder.decode(piece))
    look.feed(decoder.decode(b"", True), True)
    out |= {"json_valid": look.valid, "preview": head.decode("utf-8", errors="replace")[:PREVIEW_CHARS]}
    if look.valid:
        out |= {"json_type": look.kind, "json_keys": sorted(json.loads(k) for k in look.keys) if look.kind == "object" else None}
        out |= {"json_length": look.length if look.kind == "array" else None}
    else:
        out["error"] = "invalid JSON"


def _xml(head: bytes, rest: Iterable[bytes], whole: bool, out: dict) -> None:
    out["preview"] = decoded(head, whole)[0][:PREVIEW_CHARS]
    parser, root = ET.XMLPullParser(("start", "end")), None
    try:
        for piece in _all(head, rest):
            parser.feed(piece)
            for event, element in parser.read_events():
                root = element if root is None else root
                if event == "end":
                    element.clear()  # nothing but the root's name is kept
        parser.close()
        for _, element in parser.read_events():
            root = element if root is None else root
        out |= {"xml_valid": True, "root_tag": root.tag.rpartition("}")[2]}
    except ET.ParseError as error:
        out |= {"xml_valid": False, "error": str(error)}


def _all(head: bytes, rest: Iterable[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def look(path: str, kind: str, pieces: Iterator[bytes] | None) -> dict:
    """What is seen of one file; ``pieces`` are its bytes in order, None if it can't be read."""
    out: dict = dict.fromkeys(FIELDS) | {"path": path, "category": kind}
    if pieces is None:
        return out | {"category": "unreadable", "error": "no content"}
    try:
        parts, size = [], 0
        for piece in pieces:
            parts.append(piece)
            size += len(piece)
            if size > HEAD_BYTES:
                break
        start = b"".join(parts)
        head, over = start[:HEAD_BYTES], start[HEAD_BYTES:]
        rest = _all(over, pieces)
        if kind in ("text", "log", "markdown"):
            text, encoding = decoded(head, not over)
            lines = text.splitlines()
            preview = "\n".join(lines[:PREVIEW_LINES])
            cut = len(preview) > PREVIEW_CHARS or len(lines) > PREVIEW_LINES
            out |= {"encoding": encoding, "preview": preview[:PREVIEW_CHARS], "preview_truncated": cut, "lines": head.count(b"\n") + sum(p.count(b"\n") for p in rest)}
        elif kind == "csv":
            text, encoding = decoded(head, not over)
            reader = csv.reader(io.StringIO(text), delimiter="\t" if path.lower().endswith(".tsv") else ",")
            rows = [row for row, _ in zip(reader, range(CSV_ROWS + 1), strict=False)]
            out |= {"encoding": encoding, "columns": rows[0] if rows else [], "preview_rows": rows[1:]}
        elif kind == "json":
            _json(head, rest, out)
        elif kind == "xml":
            _xml(head, rest, not over, out)
    except (OSError, csv.Error) as error:
        return out | {"category": "unreadable", "error": str(error)}
    return out


def _opened(path: str) -> Iterator[bytes] | None:
    """The file's bytes, PIECE_BYTES at a time."""
    files, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    if files.get_file_info(name).type != pyarrow.fs.FileType.File:
        return None

    def pieces() -> Iterator[bytes]:
        with files.open_input_file(name) as data:
            while piece := data.read(PIECE_BYTES):
                yield piece

    return pieces()


def look_into(files: DataFrame) -> DataFrame:
    """A short look into each file: (path, category, content), or (path, category) of files that tasks can open by their path.

    Decoders are tried for each file, so this runs in Python, on a few files at a time.
    """
    given = "content" in files.columns

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = batch["content"] if given else [None] * len(batch)
            rows = []
            for path, kind, content in zip(batch["path"], batch["category"], contents, strict=True):
                pieces = (None if content is None else iter((bytes(content),))) if given else _opened(path)
                rows.append(look(path, kind, pieces))
            yield pd.DataFrame(rows, columns=FIELDS)

    return files.select("path", "category", *(["content"] if given else [])).mapInPandas(seen, LOOK)
