"""Strict reading of JSON of any length with bounds, a piece at a time.

A reader accepts one document and nothing after it. It refuses what the grammar of JSON refuses, a repeated key of an open
object, and whatever passes its bounds; each refusal has a kind and the place of the character it begins with. Elements at
the paths asked for are handed over as their own text, so they are parsed once, by Spark; everything else is checked and
let go, in memory that the bounds limit.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Bounds of a document.
@dataclass(frozen=True)
class Bounds:
    depth: int = 64
    scalar_bytes: int = 65_536
    key_bytes: int = 65_536
    keys: int = 4096


class JsonProblem(ValueError):
    """kind: syntax, end, trailing, root, depth, scalar, keys or duplicate_key; at: characters before it."""

    def __init__(self, kind: str, at: int):
        super().__init__(f"{kind} at character {at}")
        self.kind, self.at = kind, at


_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+'
_TOKEN = re.compile(rf'([{{}}\[\],:])|({_STRING}")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)|(true|false|null)')
_OPEN = re.compile(_STRING)
_BLANK = re.compile(r"[ \t\r\n]*+")
#: A token of the start of one of these may go on after the text at hand.
_ESCAPE_PART = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?\Z")
_NUMBER_PART, _WORDS = re.compile(r"-?[0-9]*+(?:\.[0-9]*+)?+(?:[eE][+-]?[0-9]*+)?+\Z"), ("true", "false", "null")


def _bytes(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


@dataclass
class _Frame:
    """An open object or array. `want` is the part of the tree of wanted paths that it lies in."""

    is_object: bool
    want: dict | None
    keys: set[str] = field(default_factory=set)
    key_bytes: int = 0
    key: str = ""


class Scanner:
    """Yields (path, value) of what lies at the wanted paths of a text stream. A path names keys, `*` stands for elements
    of an array; one that ends with `?` only asks whether an object or array is there. An object or array is its text, a
    string itself, a number its digits, null None."""

    def __init__(self, stream, wanted: set[str], chunk: int = 1 << 16, bounds: Bounds = Bounds(), any_root: bool = False):
        self.stream, self.chunk, self.bounds, self.any_root = stream, chunk, bounds, any_root
        self.text, self.at, self.before, self.held, self.ended = "", 0, 0, None, False  # held: where a wanted element begins
        self.tree: dict = {}
        for path in wanted:
            node = self.tree
            for part in path.rstrip("?").split("."):
                node = node.setdefault(part, {})
            node["?" if path.endswith("?") else ""] = path

    def _more(self, size: int) -> bool:
        if not self.ended:
            keep = self.at if self.held is None else min(self.at, self.held - self.before)
            new = self.stream.read(size)
            self.ended = not new
            self.text, self.before, self.at = self.text[keep:] + new, self.before + keep, self.at - keep
        return not self.ended

    def _problem(self, kind: str, at: int | None = None) -> JsonProblem:
        return JsonProblem(kind, self.before + (self.at if at is None else at))

    def _token(self) -> re.Match | None:
        """The next token; None where the document ends. What is read for a long one doubles, so time stays linear."""
        size, most = self.chunk, 6 * max(self.bounds.scalar_bytes, self.bounds.key_bytes) + 16
        while True:
            self.at = _BLANK.match(self.text, self.at).end()
            if self.at == len(self.text):
                if not self._more(size):
                    return None
                continue
            m = _TOKEN.match(self.text, self.at)
            if m and (m[3] is None or self.ended or not _NUMBER_PART.match(self.text, self.at)):
                return m
            rest = len(self.text) - self.at
            c = self.text[self.at]
            if c == '"':
                stop = _OPEN.match(self.text, self.at).end()
                if stop < len(self.text) and not _ESCAPE_PART.match(self.text, stop):
                    raise self._problem("syntax", stop)
                unfinished = "scalar" if rest > most else ""
            elif m or c in "-0123456789":
                unfinished = "" if _NUMBER_PART.match(self.text, self.at) else "syntax"
                unfinished = unfinished or ("scalar" if rest > most else "")
            else:
                part = self.text[self.at : self.at + 5]
                unfinished = "" if any(w.startswith(part) for w in _WORDS) else "syntax"
            if unfinished:
                raise self._problem(unfinished)
            if not self._more(size):
                if m:
                    return m
                raise self._problem("end" if c == '"' else "syntax")
            size *= 2

    def walk(self) -> Iterator[tuple[str, str | None]]:
        bounds, frames = self.bounds, []
        state, want, depth_held, held_path = "value", self.tree, 0, ""  # what may come; the tree at the value to come
        while True:
            m = self._token()
            if m is None:
                if state == "done":
                    return
                raise self._problem("end")
            mark, string, number, word = m.groups()
            if state == "done":
                raise self._problem("trailing")
            if string is not None and state in ("key", "first_key"):
                key = json.loads(string) if "\\" in string else string[1:-1]
                frame, size = frames[-1], _bytes(key)
                frame.key_bytes += size
                if size > bounds.scalar_bytes:
                    raise self._problem("scalar")
                if key in frame.keys:
                    raise self._problem("duplicate_key")
                if frame.key_bytes > bounds.key_bytes or len(frame.keys) >= bounds.keys:
                    raise self._problem("keys")
                frame.keys.add(key)
                want, state = frame.want and frame.want.get(key), "colon"
            elif mark in ("{", "[") and state in ("value", "first"):
                if not frames and mark != "{" and not self.any_root:
                    raise self._problem("root")
                if len(frames) >= bounds.depth:
                    raise self._problem("depth")
                if want and "?" in want:
                    yield want["?"], None
                if want and "" in want and self.held is None:
                    self.held, depth_held, held_path = self.before + self.at, len(frames), want[""]
                frames.append(_Frame(mark == "{", want))
                want, state = (None, "first_key") if mark == "{" else (want and want.get("*"), "first")
            elif mark in ("}", "]"):
                if not frames or frames[-1].is_object != (mark == "}") or state not in ("after", "first", "first_key"):
                    raise self._problem("syntax")
                frames.pop()
                if self.held is not None and depth_held == len(frames):
                    start, self.held = self.held - self.before, None
                    yield held_path, self.text[start : m.end()]
                state = "after" if frames else "done"
            elif mark == "," and state == "after":
                frame = frames[-1]
                want, state = (None, "key") if frame.is_object else (frame.want and frame.want.get("*"), "value")
            elif mark == ":" and state == "colon":
                state = "value"
            elif mark is None and state in ("value", "first"):
                if not frames and not self.any_root:
                    raise self._problem("root")
                if string is not None:
                    wanted = want and "" in want and self.held is None
                    value = (json.loads(string) if "\\" in string else string[1:-1]) if wanted or len(string) > bounds.scalar_bytes // 3 else ""
                else:
                    value = number if number is not None else None if word == "null" else word
                if value and _bytes(value) > bounds.scalar_bytes:
                    raise self._problem("scalar")
                if want and "" in want and self.held is None:
                    yield want[""], value
                state = "after" if frames else "done"
            else:
                raise self._problem("syntax")
            self.at = m.end()


def with_problems(rows: DataFrame, column: str = "json", bounds: Bounds = Bounds()) -> DataFrame:
    """Rows with what is wrong with the JSON in a column: `problem`, null if nothing is, and `at`, the characters before it.
    A null text is a document that ends at once."""
    where = rows.columns.index(column)

    def run(batches):
        for b in batches:
            kinds, places = [], []
            for text in b.column(where):
                try:
                    for _ in Scanner(io.StringIO(text.as_py() or "", newline=""), set(), bounds=bounds).walk():
                        pass
                    kinds.append(None)
                    places.append(None)
                except JsonProblem as p:
                    kinds.append(p.kind)
                    places.append(p.at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(places, pa.int64())], [*b.schema.names, "problem", "at"])

    return rows.mapInArrow(run, rows.withColumns({"problem": F.lit(None).cast("string"), "at": F.lit(None).cast("long")}).schema)
