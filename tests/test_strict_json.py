"""The strict reader against Python's own, its bounds, and ZIP files whose parts disagree."""

import io
import json
import random
import struct
import zipfile
import zlib

import pytest

from clarispan.sources import zip_file
from clarispan.sources.strict_json import Bounds, JsonProblem, Scanner, with_problems
from clarispan.sources.zip_file import ZipProblem, open_json_member


def scan(text, wanted=(), chunk=1 << 16, **bounds):
    return list(Scanner(io.StringIO(text, newline=""), set(wanted), chunk, Bounds(**bounds)).walk())


def problem(text, chunk=1 << 16, **bounds):
    with pytest.raises(JsonProblem) as e:
        scan(text, (), chunk, **bounds)
    return e.value.kind, e.value.at


BROKEN = {
    '{"a": [1 2 3]}': ("syntax", 9), '{"b": {"x" 1}}': ("syntax", 11), '{"b": {"x": 1,,}}': ("syntax", 14), '{"a": [1,]}': ("syntax", 9), '{"a": 1,}': ("syntax", 8),
    '{"a": 1} x': ("syntax", 9), '{"a": 1} {}': ("trailing", 9), '{"a": 1, "a": 2}': ("duplicate_key", 9), '{"a": 1, "\\u0061": 2}': ("duplicate_key", 9), '{"a"': ("end", 4), '{"a": "x': ("end", 6),
    "": ("end", 0), "[1]": ("root", 0), "5": ("root", 0), '{"a": 01}': ("syntax", 7), '{"a": 1.}': ("syntax", 7), '{"a": -}': ("syntax", 6), '{"a": tru}': ("syntax", 6), '{"a": NaN}': ("syntax", 6),
    '{"a": "\t"}': ("syntax", 7), '{"a": "\\x"}': ("syntax", 7), '{"a": "\\u12g4"}': ("syntax", 7), "{a: 1}": ("syntax", 1), '{"a": 1]': ("syntax", 7), '{"a" "b"}': ("syntax", 5), '{1: 2}': ("syntax", 1), "{,}": ("syntax", 1), "﻿{}": ("syntax", 0),
}


@pytest.mark.parametrize("text", BROKEN)
def test_broken_documents_are_refused_at_their_place(text):
    for chunk in (1, 2, 3, 5, 1 << 16):
        assert problem(text, chunk) == BROKEN[text]


def test_bounds():
    assert scan('{"a":' + "[" * 63 + "]" * 63 + "}") == []
    assert problem('{"a":' + "[" * 64 + "]" * 64 + "}") == ("depth", 68)
    assert scan('{"a": "' + "é" * 32768 + '"}') == [] and problem('{"a": "' + "é" * 32769 + '"}') == ("scalar", 6)
    assert problem('{"a": "' + "x" * 1_000_000, chunk=100) == ("scalar", 6) and problem('{"a": ' + "1" * 65537 + "}") == ("scalar", 6)
    many = ",".join(f'"k{i}": 1' for i in range(4097))
    assert problem("{" + many + "}")[0] == "keys" and scan("{" + many[: many.rindex(",")] + "}") == []
    assert problem('{"' + "a" * 40_000 + '": 1, "' + "b" * 40_000 + '": 1}') == ("keys", 40_008)
    assert scan('{"\\u0061\\u0062": {"ab": 1}}', ["ab.ab"]) == [("ab.ab", "1")]


def test_wanted_values_keep_their_text():
    text = '{"skip": {"a": ["b", {"c": "]}\\\\\\""}]}, "want": [{"v": 12345678901234567890, "w": [1.50, null]}, 1.50, "s\\n", null, true, [ ]], "n": {"x": 1}}'
    for size in (1, 2, 3, 7, 100):
        got = scan(text, ["want.*", "want?", "n?", "gone?", "skip.a.*.c"], size)
        assert got == [("skip.a.*.c", ']}\\"'), ("want?", None), ("want.*", '{"v": 12345678901234567890, "w": [1.50, null]}'), ("want.*", "1.50"), ("want.*", "s\n"), ("want.*", None), ("want.*", "true"), ("want.*", "[ ]"), ("n?", None)]


def test_random_documents_and_their_mutants():
    pick = random.Random(9)

    def value(depth):
        kind = pick.randrange(8 if depth < 4 else 5)
        if kind < 5:
            return [None, True, pick.randrange(-99, 10**12), pick.random() * 10 ** pick.randrange(-20, 20), "".join(pick.choices('ab"\\\n{}[],:é🙂 ', k=pick.randrange(6)))][kind]
        return [value(depth + 1) for _ in range(pick.randrange(4))] if kind < 7 else {f"k{i}": value(depth + 1) for i in range(pick.randrange(4))}

    def strict(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    def refuse(word):
        raise ValueError(word)

    for _ in range(1500):
        text = json.dumps({"a": value(0), "b": [value(1), value(1)]}, indent=pick.choice([None, 1]), ensure_ascii=pick.random() < 0.5)
        if pick.random() < 0.7:
            at = pick.randrange(len(text))
            text = text[:at] + pick.choice(['"', ",", ":", "]", "}", "[", "{", "1", ".", "e", "\\", "x", "", " "]) + text[at + pick.randrange(2) :]
        try:
            good = isinstance(json.loads(text, object_pairs_hook=strict, parse_constant=refuse), dict)
        except ValueError:
            good = False
        try:
            scan(text, ["b.*"], pick.choice([1, 7, 64]))
            assert good, text
        except JsonProblem:
            assert not good, text


def test_problems_of_a_column(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, '{"a": [1 2]}')], "id int, json string")
    assert sorted(map(tuple, with_problems(rows).select("id", "problem", "at").collect())) == [(1, None, None), (2, "end", 1), (3, "end", 0), (4, "syntax", 9)]


def archive(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name) if str(name).endswith("/") else name, data)
    return out.getvalue()


def patched(data, mark, offset, form, value, last=False):
    at = (data.rindex if last else data.index)(mark) + offset
    return data[:at] + struct.pack(form, value) + data[at + struct.calcsize(form) :]


BODY = json.dumps({"x": list(range(5000))}).encode()


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_zip_members_are_read_whole(method):
    assert open_json_member(io.BytesIO(archive([("in.JSON", BODY)], method))).read() == BODY
    assert open_json_member(io.BytesIO(archive([("d/", b""), ("d/in.json", BODY)], method))).read() == BODY
    out = io.BytesIO()

    class Unseekable(io.RawIOBase):  # then sizes come after the data
        def writable(self):
            return True

        def write(self, b):
            return out.write(bytes(b))

    with zipfile.ZipFile(Unseekable(), "w", method) as z:
        z.writestr("in.json", BODY)
    assert open_json_member(io.BytesIO(out.getvalue())).read() == BODY


GOOD = archive([("in.json", BODY)])
LINK = zipfile.ZipInfo("in.json")
LINK.external_attr = 0xA1FF << 16
BAD = {
    "empty": (b"", "format"), "cut": (GOOD[:-1], "format"), "prepended": (b"x" + GOOD, "format"), "two members": (archive([("a.json", BODY), ("b.json", BODY)]), "format"), "no json": (archive([("a.txt", BODY)]), "format"),
    "same names": (archive([("a.json", BODY), ("A.JSON", BODY)]), "format"), "up": (archive([("../a.json", BODY)]), "format"), "link": (archive([(LINK, BODY)]), "unsupported"),
    "crc in one header": (patched(GOOD, zip_file.LOCAL, 14, "<I", 1), "format"), "encrypted": (patched(patched(GOOD, zip_file.LOCAL, 6, "<H", 1), zip_file.DIRECTORY, 8, "<H", 1), "unsupported"),
    "zip64 count": (patched(GOOD, zip_file.END, 10, "<H", 0xFFFF), "unsupported"), "zip64 size": (patched(GOOD, zip_file.DIRECTORY, 24, "<I", 0xFFFFFFFF), "unsupported"), "another method": (patched(patched(GOOD, zip_file.LOCAL, 8, "<H", 12), zip_file.DIRECTORY, 10, "<H", 12), "unsupported"),
    "a later start": (patched(GOOD, zip_file.DIRECTORY, 42, "<I", 4), "format"), "folder with data": (archive([("d/", b"x"), ("in.json", BODY)]), "format"), "many": (archive([(f"d{i}/", b"") for i in range(130)] + [("in.json", BODY)]), "limit"),
    "size too small": (patched(patched(GOOD, zip_file.LOCAL, 22, "<I", 5), zip_file.DIRECTORY, 24, "<I", 5), "length"), "wrong crc": (patched(patched(GOOD, zip_file.LOCAL, 14, "<I", 7), zip_file.DIRECTORY, 16, "<I", 7), "length"),
    "size too large": (patched(patched(GOOD, zip_file.LOCAL, 22, "<I", len(BODY) + 1), zip_file.DIRECTORY, 24, "<I", len(BODY) + 1), "length"),
}


@pytest.mark.parametrize("name", BAD)
def test_zip_files_that_are_refused(name):
    data, kind = BAD[name]
    with pytest.raises((ZipProblem, zlib.error)) as e:
        open_json_member(io.BytesIO(data)).read()
    assert e.type is ZipProblem and e.value.kind == kind


def test_decoded_bytes_are_bounded():
    with pytest.raises(ZipProblem, match="limit"):
        open_json_member(io.BytesIO(GOOD), most_decoded=100)
