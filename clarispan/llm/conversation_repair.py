"""Repair of conversations by error-correcting Earley parsing (operator 13).

A conversation's roles should be derived from the grammar

    conv -> empty | turns | s turns        turns -> u reply        reply -> a rest        rest -> empty | turns

(a system row or none, then pairs of user and assistant). Its terminals have error productions with weights: a row may be
deleted (DELETE), become a user or assistant row (REROLE), and an empty user or assistant row may be inserted (INSERT); a row
that is kept or changed although it is truncated adds TRUNCATED, a blank or repeated one must be deleted. The grammar is
right-linear, so the chart is filled from the conversation's end: column i holds, for each head, the item that derives all
rows from i on, with its least (cost, audit). Candidates of equal cost differ in their first letter or go on to items of
one column, so each item keeps a link and its rank among its column's items, and no audit is spelt out before the chart is
complete. Columns are four bytes a row; time is linear in the rows.

Faults and parse need no texts: rows travel as their role, flags and a digest of 16 bytes, and a conversation's slim rows
meet in one task (an audit is one value of one row, which bounds a conversation). Texts are then streamed past their
audits, in order and a batch at a time, so a conversation of any size takes the memory of its audit.

Defined cases: null roles and texts are one space; null conv_ids are a conversation; null turns come first and count in no
gap; rows of one turn go by role and then by the digest of their text; repeated rows are rows each, and duplicates of
the first; an empty role has no initial and is never kept; a conversation without rows, or whose rows were all dropped,
has zeros and an empty audit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import materialise, resident, small_batches, table, whole_groups

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Heads: what may follow, with the terminal before it; heads that another may stand for; heads that may be empty.
CONV, TURNS, REPLY, REST = range(4)
TERMINALS = {CONV: ("s", TURNS), TURNS: ("u", REPLY), REPLY: ("a", REST)}
UNITS = ((REST, TURNS), (CONV, TURNS))
LETTERS = "DIKR"
NEVER = 1 << 60
STATS = "none boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _closed(best: list[tuple]) -> tuple[list[tuple], list[int]]:
    """A column's items with inserts and units, and their ranks. An item is (cost, letter, rank of what follows, its head)."""
    for _ in range(2):
        best[REST] = min(best[REST], best[TURNS])
        for head in (REPLY, TURNS):
            inserted = (best[TERMINALS[head][1]][0] + INSERT, "I")
            if inserted < best[head][:2]:
                best[head] = (*inserted, 0, TERMINALS[head][1])
    for head, other in UNITS:
        best[head] = min(best[head], best[other])
    keys: dict[int, tuple] = {}
    for head in sorted(range(4), key=lambda h: best[h][0]):  # what an insert goes on to costs less
        cost, letter, rank, to = best[head]
        keys[head] = (cost, letter, keys[to] if letter == "I" else rank)
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return best, [order[keys[h]] for h in range(4)]


def parse(rows: str) -> tuple[int, str]:
    """Least cost and audit of rows, a letter each: the role's initial or `-`, upper case or `_` if truncated, `x` if it must go."""
    end = (0, "", 0, REST)
    none = (NEVER, "", 0, REST)
    best, rank = _closed([end, none, none, end])
    links = bytearray()

    def link() -> bytes:
        return bytes(((LETTERS.index(letter) << 2) | to) if letter else 255 for _, letter, _, to in best)

    links += link()
    for row in reversed(rows):
        initial = "-" if row == "_" else row.lower()
        late = TRUNCATED if row.isupper() or row == "_" else 0
        column = []
        for head in range(4):
            item = (best[head][0] + DELETE, "D", rank[head], head)
            if row != "x" and head in TERMINALS:
                terminal, to = TERMINALS[head]
                if initial == terminal:
                    item = min(item, (best[to][0] + late, "K", rank[to], to))
                elif terminal in ROLES:
                    item = min(item, (best[to][0] + REROLE + late, "R", rank[to], to))
            column.append(item)
        best, rank = _closed(column)
        links += link()
    cost, head, at, audit = best[CONV][0], CONV, len(rows), []
    while links[4 * at + head] != 255:
        letter, head = LETTERS[links[4 * at + head] >> 2], links[4 * at + head] & 3
        audit.append(letter)
        at -= letter != "I"
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 16)
def _parse_short(rows: str) -> tuple[int, str]:
    """Of conversations, most are short and have few forms."""
    return parse(rows)


#: Letter of a row in parse, by initial (0: another, 1 to 3: s, u, a) and whether it is truncated.
_ROW = np.frombuffer(b"-sua_SUA", np.uint8)
#: Initials that may follow each other: su, ua, au.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True


def prepared(rows: DataFrame) -> DataFrame:
    """Rows (none, conv, turn, role, text, dropped, digest): a null conv_id is the conversation `none`. A column `dropped`, if
    there is one, marks rows that only name their conversation."""
    dropped = F.coalesce(F.col("dropped").cast("boolean"), F.lit(False)) if "dropped" in [c.lower() for c in rows.columns] else F.lit(False)
    named = rows.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), dropped.alias("dropped"))
    return named.withColumn("digest", F.unhex(F.md5("text")))


def _in_turn() -> list:
    """Order of a conversation's rows."""
    return [F.asc_nulls_first("turn"), "role", "digest"]


def repairs(rows: DataFrame) -> DataFrame:
    """Rows (STATS) for every conversation of prepared rows: faults, cost and audit of its cheapest repair."""

    def run(batches):
        resident("conversations", dict)
        for t in whole_groups(batches, ["none", "conv"]):
            none, conv, dropped = (t[c].to_numpy() for c in ("none", "conv", "dropped"))
            first = np.concatenate([[True], (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])])
            starts, group = np.flatnonzero(first), np.cumsum(first) - 1
            n = len(starts)
            live = np.flatnonzero(~dropped)
            g, initial, blank, late = group[live], *(t[c].to_numpy()[live] for c in ("initial", "blank", "late"))
            seen = t["said"].combine_chunks().dictionary_encode().indices.to_numpy()[live].astype(np.int64) + g * t.num_rows
            repeated = np.ones(len(live), bool)
            repeated[np.unique(seen, return_index=True)[1]] = False
            repeated &= ~blank
            late = late & ~blank & ~repeated
            after = np.flatnonzero(g[1:] == g[:-1])
            illegal = after[~_LEGAL[initial[after], initial[after + 1]]]
            turn, known = t["turn"].to_numpy()[live], t["known"].to_numpy()[live]
            at, turns = g[known], turn[known]
            change = np.concatenate([[True], (at[1:] != at[:-1]) | (turns[1:] != turns[:-1])])[: len(at)]
            gaps, edge = np.zeros(n, np.int64), np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
            if len(at):
                gaps[at[edge]] = turns[np.append(edge[1:], len(at)) - 1] - turns[edge] + 1 - np.bincount(at, change, n)[at[edge]].astype(np.int64)
            letters = np.where(blank | repeated, ord("x"), _ROW[initial + 4 * late]).astype(np.uint8).tobytes().decode()
            ends = np.searchsorted(g, np.arange(n), "right").tolist()
            parsed, begin = [], 0
            for end in ends:
                parsed.append((_parse_short if end - begin <= 64 else parse)(letters[begin:end]))
                begin = end
            counts = [np.bincount(x, minlength=n).astype(np.int64) for x in (g[blank], g[repeated], g[late], g[illegal])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(none[starts]), pa.array(conv[starts]), *map(pa.array, (gaps, *counts)), pa.array([c for c, _ in parsed], pa.int64()), pa.array([a for _, a in parsed], pa.string())],
                ["none", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    said = F.rtrim("text", F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "none", "conv", "turn", "role", "digest", "dropped", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("late"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"), F.unhex(F.md5(F.concat(F.hex("digest"), "role"))).alias("said"))
    slim = slim.repartition("none", "conv").sortWithinPartitions("none", "conv", *_in_turn()).select(
        "none", "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "dropped", "initial", "blank", "late", "said")
    return slim.mapInArrow(run, STATS)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (none, conv, seq, role, text): the turns of each conversation after its repair, in a partition each and in order."""
    small_batches(rows.sparkSession)

    def run(batches):
        resident("conversations", dict)
        audit, at, expected, seq = "", 0, "u", 0
        for b in batches:
            out: list[tuple] = []
            none, conv, role, text, is_audit = (b.column(c).to_pylist() for c in ("none", "conv", "role", "text", "is_audit"))

            def inserted(i: int) -> None:
                nonlocal at, expected, seq
                while at < len(audit) and audit[at] == "I":
                    out.append((none[i], conv[i], seq, ROLES[expected], ""))
                    at, expected, seq = at + 1, "a" if expected == "u" else "u", seq + 1

            for i in range(b.num_rows):
                if is_audit[i]:
                    audit, at, expected, seq = text[i], 0, "u", 0
                else:
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        out.append((none[i], conv[i], seq, role[i] if letter == "K" else ROLES[expected], text[i]))
                        seq += 1
                        if not (letter == "K" and role[i][0] == "s"):
                            expected = "a" if expected == "u" else "u"
                inserted(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 5, (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["none", "conv", "seq", "role", "text"])

    audits = found.select("none", "conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("is_audit"), F.lit(None).cast("binary").alias("digest"))
    live = rows.where("NOT dropped").select("none", "conv", "turn", "role", "text", F.lit(False).alias("is_audit"), "digest")
    both = live.unionByName(audits).repartition("none", "conv").sortWithinPartitions("none", "conv", F.desc("is_audit"), *_in_turn())
    return both.select("none", "conv", "role", "text", "is_audit").mapInArrow(run, "none boolean, conv long, seq long, role string, text string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """Rows (none, conv, repaired_sha256) of repaired_turns: SHA-256 of the turns' `role:text`, newline-joined. Streams each
    partition, whose conversations are whole and in order."""

    def run(batches):
        now, digest = None, None

        def finished(key, sha):
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], ["none", "conv", "repaired_sha256"])

        for b in batches:
            done = []
            for none, conv, role, text in zip(*(b.column(c).to_pylist() for c in ("none", "conv", "role", "text"))):
                if now != (none, conv):
                    if now is not None:
                        done.append(finished(now, digest))
                    now, digest = (none, conv), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "replace"))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not None:
            yield finished(now, digest)

    return turns.mapInArrow(run, "none boolean, conv long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by crc32(`conv_id:turn`) % 20: 0 drops a row (column `dropped`), 1 empties its text, 2 removes its `[.!?]`, 3
    repeats it, 4 makes it a user's. Nulls are one space."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spelt("role").alias("role"), spelt("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(times).alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(damaged(table(spark, sf_dir, "conversations")))
    found = materialise(repairs(rows), "conversations-repairs")
    digests = turn_digests(repaired_turns(rows, found))
    out = found.join(digests, ["none", "conv"], "left")
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten([[(ord(ch) >> k) & 1 for k in range(8)] for ch in string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), '')])),
      lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384::BIGINT)) AS c
  FROM conversations
), faulty AS (
  SELECT conv_id, turn, xor(c, 4294967295::BIGINT) % 20 AS fault, role, text FROM coded
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM faulty
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt
), said AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following
  FROM numbered
), flagged AS (
  SELECT *, left(role, 1) AS r,
    CASE WHEN t = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f
  FROM said
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (following IS NOT NULL AND concat(r, following) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM flagged GROUP BY conv_id
), step AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS b, {'c': 1000000, 'a': '', 't': []::VARCHAR[]} AS s,
    {'c': 3, 'a': 'I', 't': ['user:']} AS u, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} AS p
  FROM counts
  UNION ALL
  SELECT conv_id, i, b, s, u, list_sort([p0, {'c': u.c + 3, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}])[1] AS p
  FROM (
    SELECT conv_id, i, b, s, p0, list_sort([u0] || [{'c': x.c + 3, 'a': x.a || 'I', 't': list_append(x.t, 'user:')} for x in [b, s, p0]])[1] AS u
    FROM (
      SELECT x.conv_id, x.i + 1 AS i, {'c': x.b.c + 4, 'a': x.b.a || 'D', 't': x.b.t} AS b,
        list_sort([{'c': x.s.c + 4, 'a': x.s.a || 'D', 't': x.s.t},
          {'c': x.b.c + k.late + CASE WHEN k.r = 's' THEN 0 ELSE 1000000 END, 'a': x.b.a || 'K', 't': list_append(x.b.t, k.line)}])[1] AS s,
        list_sort([{'c': x.u.c + 4, 'a': x.u.a || 'D', 't': x.u.t}] || [
          {'c': y.c + k.late + CASE WHEN k.r = 'u' THEN 0 ELSE 3 END, 'a': y.a || CASE WHEN k.r = 'u' THEN 'K' ELSE 'R' END,
           't': list_append(y.t, CASE WHEN k.r = 'u' THEN k.line ELSE 'user:' || k.text END)} for y in [x.b, x.s, x.p]])[1] AS u0,
        list_sort([{'c': x.p.c + 4, 'a': x.p.a || 'D', 't': x.p.t},
          {'c': x.u.c + k.late + CASE WHEN k.r = 'a' THEN 0 ELSE 3 END, 'a': x.u.a || CASE WHEN k.r = 'a' THEN 'K' ELSE 'R' END,
           't': list_append(x.u.t, CASE WHEN k.r = 'a' THEN k.line ELSE 'assistant:' || k.text END)}])[1] AS p0
      FROM step x JOIN (
        SELECT conv_id, i, r, text, role || ':' || text AS line, CASE f WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1000000 END AS late FROM flagged
      ) k ON k.conv_id IS NOT DISTINCT FROM x.conv_id AND k.i = x.i + 1
    )
  )
), done AS (
  SELECT x.conv_id, list_sort([x.b, x.p])[1] AS best FROM step x JOIN counts c ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.n = x.i
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(d.best.c, 0) AS BIGINT) AS cost, coalesce(d.best.a, '') AS audit, sha256(coalesce(array_to_string(d.best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
