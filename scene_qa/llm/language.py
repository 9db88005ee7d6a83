"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Beside the languages stands one class for anything else, so that a text unlike all of them is rejected: under it a trigram is as
likely as one FLOOR_SIGMAS standard deviations below what texts of the languages themselves show."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise, pack, small_join, utf8

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled rows of each language that the text model is fitted on: those with the least hashes of id and text.
TRAIN_ROWS = 400
#: Documents whose best language has a lower posterior, or without a letter, are rejected.
THRESHOLD = 0.5
BUCKETS = 1 << 16
#: A text weighs as at most this many of its trigrams: they are not independent.
TRIGRAMS_COUNTED = 150.0
#: How often the declared language is right.
DECLARED_RIGHT = 0.85
#: Pseudo-counts that a host's prior takes from its suffix, and a suffix's from all rows.
HOST_PRIOR, SUFFIX_PRIOR = 20.0, 50.0
#: Prior of a text in none of the languages, and how far below the mean its trigrams lie.
OTHER_PRIOR, FLOOR_SIGMAS = 0.01, 3.0


@dataclass
class TextModel:
    """Log-likelihoods of hashed byte trigrams, one row for each bucket, one column for each language; floor: that of any
    trigram in another language."""

    languages: tuple[str, ...]
    table: np.ndarray
    floor: float


def _buckets(data: bytes) -> np.ndarray:
    """Of each trigram of the letters of a text, A-Z lower-cased; other ASCII parts words."""
    a = np.frombuffer(b" " + data.lower() + b" ", np.uint8)
    a = np.where((a >= 128) | (a >= 97) & (a <= 122), a, 32).astype(np.uint32)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    return ((a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", languages: tuple[str, ...] = LANGUAGES, rows: int = TRAIN_ROWS, key: str = "doc_id") -> TextModel:
    """A naive Bayes model from at most `rows` whole texts of each language; a language without any is even. Of equal
    hashes the least key comes first."""
    data = labelled.select(F.lower(F.substring_index(column(label), "-", 1)).alias("lang"), utf8(column(text)).alias("data"), column(key).alias("key")).where(F.col("lang").isin(*languages))
    sizes = {r["lang"]: r["n"] for r in data.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    # by a hash, so that only a little over `rows` texts of each language leave their tasks
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, (1.3 * rows + 50) / max(1, sizes.get(lang, 0))))])
    data = data.withColumn("h", F.xxhash64("key", "data"))
    near = data.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.element_at(share, F.col("lang")))
    chosen = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))).where(F.col("_n") <= rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[languages.index(lang)] += np.bincount(_buckets(x.as_py()), minlength=BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    found = chosen.select("lang", "data").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets rows at most
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"], found["lang"]] = found["n"]
    return model_of(counts, tuple(languages))


def model_of(counts: np.ndarray, languages: tuple[str, ...]) -> TextModel:
    """The model of trigram counts, a row for each bucket; its floor is taken from the languages that have any."""
    smooth = counts + 0.5
    table = np.log(smooth / smooth.sum(axis=0))
    known = counts.sum(axis=0) > 0
    if not known.any():
        return TextModel(languages, table.astype(np.float32), -np.inf)
    share = counts[:, known] / counts[:, known].sum(axis=0)
    mean = (share * table[:, known]).sum(axis=0)
    deviation = np.sqrt((share * (table[:, known] - mean) ** 2).sum(axis=0))
    return TextModel(languages, table.astype(np.float32), float(mean.mean() - FLOOR_SIGMAS * deviation.mean()))


def fold(text: Column, key: Column) -> Column:
    """0 or 1 by a hash of a row's key and text: the half that it belongs to."""
    return F.pmod(F.xxhash64(F.lit(3), key, utf8(text)), F.lit(2)).cast("int")


def cross_fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", **bounds) -> tuple[TextModel, TextModel]:
    """A model for each half of the rows, fitted on the other half: identify() then judges no text that it was fitted on."""
    half = fold(column(text), column(key))
    one, two = (fit(labelled.where(half == other), text, label, key=key, **bounds) for other in (1, 0))
    return one, two


def text_log_likelihood(model: TextModel, data: bytes) -> np.ndarray:
    """Of each language, and last of anything else; all zero without a letter. The whole text counts, with the weight of
    TRIGRAMS_COUNTED."""
    b = _buckets(data)
    total = np.zeros(len(model.languages) + 1)
    if not len(b):
        return total
    for at in range(0, len(b), 1 << 16):
        total[:-1] += model.table[b[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
    total[-1] = model.floor * len(b)
    return total * min(1.0, TRIGRAMS_COUNTED / len(b))


def declared_language(said: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(said.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1)))


def suffix_of(host: Column) -> Column:
    """The last label of a host with a dot in it; else null."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def host_priors(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> tuple[DataFrame, DataFrame, list[float]]:
    """evidence(host, suffix, declared) -> counts by (host), counts by (suffix), counts of all rows: one array of a count
    for each language. Only declared languages of the list are counted; grouped sums, combined before the shuffle."""
    ones = [F.sum((F.col("declared") == lang).cast("long")).alias(lang) for lang in languages]
    known = evidence.where(F.col("declared").isin(*languages))
    hosts = known.where("host is not null").groupBy("host", "suffix").agg(*ones)
    hosts = materialise(hosts.select("host", "suffix", F.array(*languages).alias("host_counts")))
    sums = lambda: [F.sum(F.col("host_counts")[i]).alias(lang) for i, lang in enumerate(languages)]
    suffixes = materialise(hosts.where("suffix is not null").groupBy("suffix").agg(*sums()).select("suffix", F.array(*languages).alias("suffix_counts")))
    everything = known.agg(*ones).first()
    return hosts.select("host", "host_counts"), suffixes, [float(x or 0) for x in everything]


def fuse(model: TextModel, data: list[bytes], declared: list[str], host_counts: list, suffix_counts: list, everything: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the languages and, last, of anything else, one row for each document, and whether its text has a letter.

    Prior of a host: its counts of declared languages, less the document's own, smoothed by its suffix's prior, which is
    smoothed by that of all rows; OTHER_PRIOR of it is anything else's. To it come the declaration, right in DECLARED_RIGHT of
    the cases, any being as likely on a text in none of the languages, and the text."""
    k, n = len(model.languages), len(data)
    if not n:
        return np.zeros((0, k + 1)), np.zeros(0, bool)
    own = np.array([[d == lang for lang in model.languages] for d in declared], float).reshape(n, k)
    some = own.any(axis=1, keepdims=True)
    counts = lambda col: np.array([x if x is not None else [0] * k for x in col], float).reshape(n, k)
    less = lambda c: np.maximum(c - own, 0)
    base = less(np.broadcast_to(everything, (n, k))) + 1
    base = base / base.sum(axis=1, keepdims=True)
    suffix = less(counts(suffix_counts))
    suffix = (suffix + SUFFIX_PRIOR * base) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_PRIOR)
    host = less(counts(host_counts))
    host = (host + HOST_PRIOR * suffix) / (host.sum(axis=1, keepdims=True) + HOST_PRIOR)
    prior = np.hstack([host * (1 - OTHER_PRIOR), np.full((n, 1), OTHER_PRIOR)])
    said = np.where(own > 0, DECLARED_RIGHT, (1 - DECLARED_RIGHT) / max(1, k - 1))
    said = np.where(some, np.hstack([said, np.full((n, 1), 1 / k)]), 1.0)
    text = np.array([text_log_likelihood(model, x) for x in data])
    score = text + np.log(prior) + np.log(said)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True), np.array([len(_buckets(x)) > 0 for x in data], bool)


def identify(docs: DataFrame, model: TextModel | tuple[TextModel, TextModel], text: str = "text", declared: str | None = "lang", host: str | None = "source", threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(_row struct of all columns, language, posterior, accepted) of every row of docs.

    declared: the column of the language that the markup declares (en-US counts as en); host: the column of the host, whose
    last label is the address suffix; None: no such evidence. A null, unknown or missing value of either is no
    evidence. model: one, or cross_fit()'s two, of which the row's fold() says which judges it. language is the likeliest of the
    model's languages, of equal ones the first in its order. Rejected is a text without letters (null, empty, digits), which
    leaves the prior and the declaration, and one whose posterior is under the threshold: unlike all the languages, or
    like several. Whole texts are read, however long; repeated rows get equal results and all stay; an empty table gives no rows.
    Host priors are broadcast up to a counted size and joined by a shuffle beyond it."""
    said = declared_language(column("_row", declared)) if declared else F.lit("")
    at = F.lower(column("_row", host).cast("string")) if host else F.lit(None).cast("string")
    models = model if isinstance(model, tuple) else (model,)
    half = fold(column("_row", text), column("_row", key)) if len(models) > 1 else F.lit(0)
    rows = pack(docs).select("_row", said.alias("declared"), at.alias("host"), half.alias("fold")).withColumn("suffix", suffix_of(F.col("host")))
    languages = models[0].languages
    hosts, suffixes, everything = host_priors(rows.select("host", "suffix", "declared"), languages)
    rows = small_join(small_join(rows, hosts, ["host"]), suffixes, ["suffix"])
    shared = docs.sparkSession.sparkContext.broadcast((models, np.array(everything)))

    @F.pandas_udf("language string, posterior double, accepted boolean")
    def judge(data: pd.Series, declared: pd.Series, host_counts: pd.Series, suffix_counts: pd.Series, fold: pd.Series) -> pd.DataFrame:
        models, everything = shared.value
        p, lettered = np.zeros((len(data), len(languages) + 1)), np.zeros(len(data), bool)
        for k, model in enumerate(models):
            mine = np.flatnonzero(fold.to_numpy() == k)
            part = [c.iloc[mine].tolist() for c in (data, declared, host_counts, suffix_counts)]
            p[mine], lettered[mine] = fuse(model, [bytes(x) for x in part[0]], *part[1:], everything)
        best = p[:, :-1].argmax(axis=1)
        top = p[np.arange(len(p)), best]
        return pd.DataFrame({"language": [languages[i] for i in best], "posterior": top, "accepted": lettered & (top >= threshold)})

    judged = rows.withColumn("_j", judge(utf8(column("_row", text)), F.col("declared"), F.col("host_counts"), F.col("suffix_counts"), F.col("fold")))
    return judged.select("_row", "_j.language", "_j.posterior", "_j.accepted")


def markup_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of pages in _row, and text, lang and source as identify() takes them: the words between tags, the
    lang attribute of <html>, and the host of the url. Native functions only."""
    raw = F.coalesce(column("_row", html), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-zA-Z]+;", " ")
    return pack(pages).select("_row", bare.alias("text"), F.regexp_extract(raw, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("lang"), F.regexp_extract(F.coalesce(column("_row", url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1).alias("source"))
