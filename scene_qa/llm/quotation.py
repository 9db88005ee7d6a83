"""Quotation linking: conversations in reply order, without the text that replies quote."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise, small_join

_MARK = re.compile(r"^(?:[ \t]{0,3}>)+ ?")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Of the polynomial that names a run of lines.
_PRIME, _BASE = (1 << 127) - 1, int.from_bytes(hashlib.sha256(b"run of lines").digest()[:15], "big")


def passages(text: str) -> list[tuple[int, str]]:
    """(quote level, text) of each maximal run of lines of one level; empty lines of level 0 part own passages."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        level, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
        if out and out[-1][0] == level and (level or body.strip()):
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def digest(passage: str) -> bytes | None:
    """Of the passage with white space runs as one space and A-Z lower-cased; None if nothing is left."""
    normal = _SPACE.sub(" ", passage).strip(" ").encode().lower()
    return hashlib.sha256(normal).digest()[:16] if normal else None


def line_digests(passage: str) -> list[bytes]:
    """Of each line that isn't blank, in order."""
    return [d for line in passage.split("\n") if (d := digest(line))]


@lru_cache(maxsize=1 << 16)
def _shift(length: int) -> int:
    return pow(_BASE, length, _PRIME)


def prefixes(lines: list[bytes]) -> list[int]:
    """Of one polynomial: with them the digest of any run of the lines costs the same, however long it is."""
    out = [0]
    for d in lines:
        out.append((out[-1] * _BASE + int.from_bytes(d, "big")) % _PRIME)
    return out


def run_digest(prefix: list[int], start: int, length: int) -> bytes:
    return ((prefix[start + length] - prefix[start] * _shift(length)) % _PRIME).to_bytes(16, "big")


def parse(text: str) -> tuple[str, list[bytes], list[bytes], list[tuple[int, bytes, int, bytes, bytes]]]:
    """The text without quoted lines, the digests of its own passages (of each line, of each run of lines between quotes or
    empty lines, and of all), those of its own lines in order, and (level, digest, number of lines, digest as a run of lines,
    empty for one line, digest of the first line) of the quoted passages, in order."""
    parts = passages(text)
    own = [body for level, body in parts if not level]
    units = [*own, *(line for body in own for line in body.split("\n")), "\n".join(own)]
    mine = dict.fromkeys(d for u in units if (d := digest(u)))
    quoted = []
    for level, body in parts:
        if level and (d := digest(body)):
            lines = line_digests(body)
            quoted.append((level, d, len(lines), run_digest(prefixes(lines), 0, len(lines)) if len(lines) > 1 else b"", lines[0]))
    return "\n".join(own).strip("\n") if any(level for level, _ in parts) else text, list(mine), line_digests("\n".join(own)), quoted


_QUOTED = pa.list_(pa.struct([("level", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("run", pa.binary()), ("first", pa.binary())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(t) for t in batch.column(3).to_pylist()]
        cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary())))]
        quoted = pa.array([[{"level": a, "digest": b, "n": n, "run": c, "first": e} for a, b, n, c, e in f[3]] for f in found], _QUOTED)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols, quoted], ["conv", "turn", "role", "body", "own", "lines", "quoted"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ck, tk, lines, places array<struct<pos, lengths>>) -> (ck, tk, digest) of the different runs of lines that begin at
    these places and have these lengths."""
    for batch in batches:
        for row in batch.to_pylist():
            prefix, n = prefixes(row["lines"]), len(row["lines"])
            if mine := list(dict.fromkeys(run_digest(prefix, p["pos"], k) for p in row["places"] for k in p["lengths"] if p["pos"] + k <= n)):
                yield pa.RecordBatch.from_arrays([pa.array([row["ck"]] * len(mine)), pa.array([row["tk"]] * len(mine), pa.int64()), pa.array(mine, pa.binary())], ["ck", "tk", "digest"])


def _position(rows: DataFrame) -> DataFrame:
    """rows(ck, rk, tk, h) with a gapless position in each conversation ck, by (root rk, turn tk, h). A conversation of
    any length is numbered in stretches: of roots, of the turns of a root, and of a 256th of the h of a turn."""
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.expr("rk div 1024 - int(rk < 0)")).withColumn("t", F.expr("tk div 64 - int(tk < 0)")).withColumn("u", F.shiftrightunsigned("h", 56))
    cell = ["ck", "s", "rk", "t", "tk", "u"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"))

    def offsets(inside: list[str], of: list[str], name: str) -> DataFrame:
        counts = cells.groupBy(*inside, *of).agg(F.sum("n").alias("n"))
        return counts.select(*inside, *of, F.coalesce(F.sum("n").over(before(inside, of)), F.lit(0)).alias(name))

    placed = offsets(["ck", "s", "rk", "t"], ["tk", "u"], "a").join(offsets(["ck", "s", "rk"], ["t"], "b"), ["ck", "s", "rk", "t"]).join(offsets(["ck", "s"], ["rk"], "c"), ["ck", "s", "rk"]).join(offsets(["ck"], ["s"], "d"), ["ck", "s"])
    placed = placed.select(*cell, (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("to"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*cell).orderBy("h"))).join(placed, cell)
    return numbered.withColumn("position", (F.col("to") + F.col("nth") - 1).cast("long"))


def reply_order(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of messages: conv_id, position, turn, role, text, reply_to, root, depth, n_quotes, n_linked.

    text is without quoted lines. A quoted passage links to its original: the first turn of the conversation with an
    equal passage of its own, or in which the passage's lines stand in sequence; blank lines and quotes between them don't
    part them. reply_to is the original, earlier than the message, of the
    quote with the lowest level, the first of those; null without one. Position counts from 0 by (root, turn): a thread
    stays together and a reply follows what it answers. Depth counts the replies up to the root.

    A null text is empty, a null turn comes first and links to nothing, null conv_ids are one conversation of their
    own; repeated rows each keep a row, and rows of one turn have one parent. Equal originals: the earliest turn. A quote of what
    comes later links to nothing. A very long message is parsed whole. Only the four named columns are read, whatever others are
    called. An empty table gives no rows."""
    named = messages.select(column(conv_id).alias("conv"), column(turn).cast("long").alias("turn"), column(role).cast("string").alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
    schema = f"conv {named.schema['conv'].dataType.simpleString()}, turn long, role string, body string, own array<binary>, lines array<binary>, quoted array<struct<level:int,digest:binary,n:int,run:binary,first:binary>>"
    parsed = materialise(named.mapInArrow(_parsed, schema).withColumn("row", F.monotonically_increasing_id()))  # numbered once, when written
    parsed = parsed.withColumn("ck", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("-"))).withColumn("tk", F.coalesce("turn", F.lit(-(1 << 63)).cast("long"))).withColumn("h", F.xxhash64("role", "body"))
    quotes = parsed.where("turn is not null").select("ck", "tk", F.posexplode("quoted").alias("at", "q")).select("ck", "tk", "at", "q.*").distinct()
    # a run of lines is looked up by its first line, and compared only where that stands
    starts = materialise(quotes.where("n > 1").groupBy("ck", F.col("first").alias("line")).agg(F.collect_set("n").alias("lengths")))
    # a quote is looked up as a passage and as a run of lines
    quotes = quotes.withColumn("key", F.explode(F.array("digest", "run"))).where(F.octet_length("key") > 0)
    wanted = quotes.select("ck", "key").distinct()
    own = parsed.where("turn is not null").select("ck", "tk", F.explode("own").alias("key"))
    long = parsed.where("turn is not null and size(lines) > 1")
    places = small_join(long.select("row", "ck", F.posexplode("lines").alias("pos", "line")), starts, ["ck", "line"], "inner")
    places = places.groupBy("row").agg(F.collect_list(F.struct("pos", "lengths")).alias("places"))  # of one message
    inside = long.select("row", "ck", "tk", "lines").join(places, "row").drop("row")
    own = own.union(inside.mapInArrow(_runs, "ck string, tk long, digest binary"))
    originals = own.join(wanted, ["ck", "key"], "left_semi").groupBy("ck", "key").agg(F.min("tk").alias("original"))
    linked = materialise(quotes.join(originals, ["ck", "key"]).where("original < tk"))
    links = linked.groupBy("ck", "tk").agg(F.min(F.struct("level", "at", "original"))["original"].alias("reply_to"), F.collect_set(F.struct("digest", "run")).alias("hit"))  # of the quotes of one turn
    state = materialise(links.select("ck", "tk", F.col("reply_to").alias("rk"), F.lit(1).cast("long").alias("depth")))
    while True:  # pointer jumping: every round doubles the way to the root
        up = state.select("ck", F.col("tk").alias("rk"), F.col("rk").alias("_rk"), F.col("depth").alias("_depth"))
        state = materialise(state.join(up, ["ck", "rk"], "left").select("ck", "tk", F.coalesce("_rk", "rk").alias("rk"), (F.col("depth") + F.coalesce("_depth", F.lit(0).cast("long"))).alias("depth"), F.col("_rk").isNotNull().alias("moved")))
        if not state.where("moved").head(1):
            break
        state = state.drop("moved")
    rows = parsed.join(links.join(state.drop("moved"), ["ck", "tk"]), ["ck", "tk"], "left")
    rows = rows.withColumn("rk", F.coalesce("rk", "tk")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    rows = rows.withColumn("n_linked", F.when(F.col("hit").isNull(), 0).otherwise(F.size(F.filter("quoted", lambda q: F.array_contains(F.col("hit"), F.struct(q["digest"].alias("digest"), q["run"].alias("run"))))))).withColumn("n_quotes", F.size("quoted"))
    rows = rows.select("ck", "tk", "rk", "h", "conv", "turn", "role", "body", "reply_to", "depth", "n_quotes", "n_linked")
    root = F.when(F.col("turn").isNull(), F.lit(None).cast("long")).otherwise(F.col("rk"))
    return _position(rows).select(F.col("conv").alias("conv_id"), "position", "turn", "role", F.col("body").alias("text"), "reply_to", root.alias("root"), "depth", "n_quotes", "n_linked")
