"""Repeated substrings of a whole corpus by prefix-free parsing.

A rolling hash gives each byte position of a text a value; the trigger of a 200-byte window is the least value
among the first REACH positions of the window, so equal windows have equal triggers at equal offsets. The
windows that share a trigger are one run of positions, and a phrase is all the bytes they cover: phrases overlap
by a window, and no window is cut. The parse is the list of phrases of each text, the dictionary the distinct ones.

A window recurs if its phrase recurs in the parse, or if two phrases of the dictionary have it as the head of a
suffix. Equal windows hold the same CORE bytes at their trigger, so only phrases of one core can share one, and
only cores with two phrases go back to the texts for their bytes. Their suffixes are sorted (a suffix
array over the phrases of a core) and neighbours that agree on a window's length are repeats. Corpus order is thus
made inside each core, where it is needed, and never as one array that a single task would have to hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, dealt_join, materialise, small_join, utf8

GRAM = 12
#: Bytes of the phrases of one core held by a task; a core with more has its windows counted by a grouped aggregate.
CORE_BYTES = 1 << 20
_CHUNK = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def reach(window: int) -> int:
    """Positions of a window among which its trigger is sought; the rest, and GRAM at least, is its core."""
    return max(1, window * 4 // 5 - GRAM)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(_MIX[0]) + data[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MIX[1])
    return h >> np.uint64(32)


def _runs(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigger, first and last window start of each run of windows with one trigger."""
    span, windows = reach(window), len(data) - window + 1
    out = []
    for at in range(0, windows, _CHUNK):
        many = min(_CHUNK, windows - at)
        keys = (_grams(data[at : at + many + span - 1 + GRAM - 1]) << np.uint64(32)) + np.arange(many + span - 1, dtype=np.uint64)
        padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, span)  # the least of a sliding span: of a block's end and the next one's start
        left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:many]
        right = np.minimum.accumulate(blocks, axis=1).reshape(-1)[span - 1 : span - 1 + many]
        out.append((np.minimum(left, right) & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    trigger = np.concatenate(out)
    first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    return trigger[first], first, np.r_[first[1:], windows] - 1


def phrases(data: bytes, window: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Core hash, phrase hash, start, size and trigger (from the start) of each phrase of a text; a text shorter than a window has none. The
    phrase's hash covers where its trigger is, and together with the core's hash it has 128 bits."""
    if len(data) < window:
        return [], [], *[np.zeros(0, np.int32)] * 3
    core, digest = window - reach(window) + 1, xxhash.xxh3_64_intdigest
    trigger, first, last = _runs(np.frombuffer(data, np.uint8), window)
    size = last - first + window
    cores = [digest(data[t : t + core]) - (1 << 63) for t in trigger.tolist()]
    wholes = [digest(data[a : a + n], t - a) - (1 << 63) for t, a, n in zip(trigger.tolist(), first.tolist(), size.tolist(), strict=True)]
    return cores, wholes, first.astype(np.int32), size.astype(np.int32), (trigger - first).astype(np.int32)


def _parse(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, data) -> (core, whole, id, start, size, at), a row for each phrase."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            cores, wholes, first, size, at = phrases(text.as_py(), window)
            if cores:
                yield pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), pa.array(wholes, pa.int64()), pa.array(np.full(len(cores), key)), pa.array(first), pa.array(size), pa.array(at)], ["core", "whole", "id", "start", "size", "at"])


def _repeated(parts: list[bytes], at: list[int], window: int) -> list[list[int]]:
    """For each distinct phrase of one core, whose trigger is at `at`: the window starts that recur in another. Equal
    windows have their trigger at one place, so the phrases' suffixes are sorted for one such place at a time: a suffix
    array of the phrases, of which only a slice is held."""
    found: list[list[int]] = [[] for _ in parts]
    for back in range(max(at) + 1):
        heads = sorted((parts[k][t - back : t - back + window], k) for k, t in enumerate(at) if back <= t and t - back + window <= len(parts[k]))
        last = -1
        for (head, k), (after, j) in zip(heads, heads[1:], strict=False):
            if head == after:
                if last != k:
                    found[k].append(at[k] - back)
                found[j].append(at[j] - back)
                last = j
    return found


def _spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that windows at these starts cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + window))
        else:
            out.append((s, s + window))
    return out


def _sorted_cores(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (core, whole, phrase, at) in order of core -> (core, whole, a, b): the bytes of a phrase that recur."""
    core, held, out = None, {}, []

    def flush() -> None:
        if len(held) > 1:
            for key, starts in zip(held, _repeated(*map(list, zip(*held.values(), strict=True)), window), strict=True):
                out.extend((core, key, a, b) for a, b in _spans(starts, window))

    def record() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["core", "whole", "a", "b"])

    for batch in batches:
        for c, whole, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            if c != core:
                flush()
                core, held = c, {}
            held[whole] = text.as_py(), at
        yield record()
        out = []
    flush()
    yield record()


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and the SHA-256 of what is kept."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    digest, at = hashlib.sha256(), 0
    for a, b in merged:
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return len(data), sum(b - a for a, b in merged), len(merged), digest.digest()


def repeated_spans(texts: DataFrame, window: int = 200, core_bytes: int = CORE_BYTES) -> DataFrame:
    """texts(id long, data binary): distinct texts -> (id, spans array<struct<a int, b int>>): bytes that lie in a
    window which also starts elsewhere in these texts. Texts without any are left out."""
    parse = materialise(texts.select("id", "data").mapInArrow(lambda it: _parse(it, window), "core long, whole long, id long, start int, size int, at int"))
    # a core met once has no repeats; one whose phrases are all equal needs no bytes
    cores = parse.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    cores = materialise(cores.where("n > 1").select("core", (F.col("low") != F.col("high")).alias("mixed"), "n"))
    met = materialise(dealt_join(parse, cores, ["core"], "n", "id"))
    dictionary = materialise(met.where("mixed").groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "start", "size", "at")).alias("first")))
    large = materialise(dictionary.groupBy("core").agg(F.sum("first.size").alias("bytes")).where(F.col("bytes") > core_bytes).select("core", F.lit(True).alias("large")))
    wanted = dictionary.groupBy("first.id").agg(F.collect_list(F.struct("core", "whole", "first.start", "first.size", "first.at")).alias("p"))  # phrases of one text
    read = wanted.join(texts.select("id", "data"), "id").select("data", F.explode("p").alias("p"))
    read = read.select("p.core", "p.whole", F.substring("data", F.col("p.start") + 1, F.col("p.size")).alias("phrase"), "p.at")
    many = large.head(1)
    if many:
        read = materialise(small_join(read, large, ["core"]))
    few = (read.where("large is null").drop("large") if many else read).repartition("core").sortWithinPartitions("core")
    part = few.mapInArrow(lambda it: _sorted_cores(it, window), "core long, whole long, a int, b int")
    if many:
        each = read.where("large").select("core", "whole", "phrase", F.explode(F.sequence(F.lit(0), F.octet_length("phrase") - window)).alias("a"))
        each = each.select("core", "whole", "a", F.unhex(F.sha2(F.substring("phrase", F.col("a") + 1, F.lit(window)), 256)).alias("w"))
        again = each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        part = part.union(each.join(again, "w").select("core", "whole", "a", (F.col("a") + window).alias("b")))
    part = part.groupBy("core", "whole").agg(F.collect_list(F.struct("a", "b")).alias("part"))  # inside one phrase
    marked = dictionary.select("core", "whole", "n", (F.col("n") > 1).alias("all")).join(part, ["core", "whole"], "left")
    marked = materialise(marked.where("all or part is not null"))
    moved = F.transform("part", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    found = dealt_join(met.where("mixed"), marked, ["core", "whole"], "n", "id").select("id", F.explode(F.when(F.col("all"), F.array(span)).otherwise(moved)).alias("s"))
    found = found.union(met.where("not mixed").select("id", span.alias("s")))
    return materialise(found.groupBy("id").agg(F.collect_list("s").alias("spans")))  # of one text


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 200, core_bytes: int = CORE_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes.

    Every byte covered by a `window`-byte string that also starts anywhere else, in the same document or another, goes;
    strings are judged on the input. Null counts as empty; texts shorter than a window keep all. Rows with
    equal texts are one text that recurs, so all of it goes if it is as long as a window; ids may repeat or be
    null. A very long text is parsed in pieces that overlap. Only the two named columns are read, whatever others are called. An
    empty table gives no rows."""
    keyed = docs.select(column(doc_id).alias("doc_id"), utf8(column(text)).alias("data")).withColumn("digest", F.unhex(F.sha2("data", 256)))
    texts = materialise(keyed.groupBy("digest").agg(F.first("data").alias("data"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    spans = repeated_spans(texts, window, core_bytes)
    schema = "digest binary, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data, n, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = data.as_py()
                ranges = [(0, len(data))] if n > 1 and len(data) >= window else [(s["a"], s["b"]) for s in spans.as_py() or []]
                size, gone, runs, kept = _cut(data, ranges)
                row = (digest, n, size, gone, runs, kept.hex())
                rows.append((*row, _kept(data, ranges)) if keep_text else row)
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(rows[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(rows[0])])

    judged = materialise(texts.join(spans, "id", "left").select("digest", "data", "n", "spans").mapInArrow(cut, schema))
    return dealt_join(keyed.select("doc_id", "digest"), judged, ["digest"], "n", "doc_id").drop("digest")


def _kept(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in sorted(ranges):
        out.append(data[at : max(at, a)])
        at = max(at, b)
    return b"".join([*out, data[at:]])
