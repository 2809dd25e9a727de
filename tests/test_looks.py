"""Looks into files: previews, and JSON and XML that are checked in pieces."""

import json
import random

import pytest
from emberline.sources import looks


def seen(kind, *pieces, path="f"):
    return looks.look(path, kind, iter(pieces))


def plain(text):
    try:
        value = json.loads(text)
    except ValueError:
        return False, None, None, None
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
    return True, kind, sorted(value) if kind == "object" else None, len(value) if kind == "array" else None


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 5 or kind == 7:
        return {rng.choice(["a", "b", 'q"', "ü", "\\"]) + str(rng.randrange(3)): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -1.5e10, 12345678901234567890, "", "text\n é ☃", 'x"y\\z'])


@pytest.mark.parametrize("size", [1, 3, 7, 10_000])
def test_json_in_pieces_equals_a_whole_parse(monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(looks.JsonLook, "BACK", 2)
    for i in range(400):
        text = json.dumps(made(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if i % 2:  # spoiled somewhere
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", ",", "}", "]", "x", '"', "\x01", ":", "[", "1", " "]) + text[at + rng.randrange(2) :]
        data = text.encode()
        r = seen("json", *[data[i : i + size] for i in range(0, len(data), size)])
        assert (r["json_valid"], r["json_type"], r["json_keys"], r["json_length"]) == plain(text), text


def test_texts():
    r = seen("text", b"l1\nl2\n" + b"x" * 900)
    assert (r["lines"], r["preview_truncated"], len(r["preview"]), r["encoding"]) == (2, True, 500, "utf-8")
    assert seen("text", "é".encode("cp1252") + b"!a")["encoding"] == "cp1252"
    assert seen("text", b"\x81!a")["encoding"] == "unknown (best-effort decode)"
    assert seen("text")["lines"] == 0
    assert seen("csv", b"h\ti\n1\t2\n" * 9, path="b.tsv")["preview_rows"] == [["1", "2"], ["h", "i"]] * 2 + [["1", "2"]]


def test_a_character_over_the_heads_end_does_not_spoil_the_encoding(monkeypatch):
    monkeypatch.setattr(looks, "HEAD_BYTES", 101)
    r = seen("text", ("x" * 100 + "é" * 50 + "\n").encode())
    assert (r["encoding"], r["lines"], r["preview"]) == ("utf-8", 1, "x" * 100)


def test_xml_in_pieces():
    r = seen("xml", b"<?xml version='1.0'?><r xm", b"lns='u'><a/>", b"<b>t</b></r>")
    assert (r["xml_valid"], r["root_tag"], r["error"]) == (True, "r", None)
    for bad in (b"<r>", b"", b"<r></s>", b"<r/><s/>"):
        assert seen("xml", bad)["xml_valid"] is False


def test_files_by_path_and_content(spark, tmp_path):
    rows = [("a.txt", "text", bytearray(b"a\nb")), ("f", "text", None), ("g", "binary", bytearray(b"\0"))]
    got = {r.path: r for r in looks.look_into(spark.createDataFrame(rows, "path string, category string, content binary")).collect()}
    assert (got["a.txt"].lines, got["f"].category, got["f"].error, got["g"].preview) == (1, "unreadable", "no content", None)
    (tmp_path / "j.json").write_bytes(b"[" + b'{"k": 1},' * 500_000 + b"1]")
    with (tmp_path / "big.log").open("wb") as out:  # 3 GB, of which the disk holds little
        out.write(b"first\nsecond\n")
        out.truncate(3 << 30)
    paths = [(str(tmp_path / "j.json"), "json"), (f"file:{tmp_path}/big.log", "log"), (str(tmp_path / "none"), "text"), (str(tmp_path), "text")]
    got = {r.path.rpartition("/")[2]: r for r in looks.look_into(spark.createDataFrame(paths, "path string, category string")).collect()}
    assert (got["j.json"].json_valid, got["j.json"].json_type, got["j.json"].json_length) == (True, "array", 500_001)
    assert got["big.log"].lines == 2 and got["big.log"].preview.startswith("first\nsecond")
    assert got["none"].category == got[tmp_path.name].category == "unreadable"
