"""Ranked search, near vectors and vector codes against plain loops and their SQL, with the edge cases of their docstrings."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scene_qa.llm import lexical_search, queries, vector_codes, vector_copies

WORDS = ["the", "Flood", "road", "water", "près", "a1", "b", "rain's", "tree", "日本", "x_y"]


def oracle(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.execute(queries.oracle_sql()[query])
    return [d[0] for d in out.description], Counter(out.fetchall())


def search_fixture(seed=3, n=150):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, "the flood water"), (None, None), (500, "…!? --"), (501, ""), (-4, "flood " * 3000), (502, docs[11][1]), (503, docs[11][1])]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(9)] + [(9, None), (10, "..."), (11, "unknown"), (3, "water water the"), (None, "tree")]
    return docs, items


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    sizes = [c.total() for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for (doc, _), c, n in zip(docs, counts, sizes, strict=True):
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, gone, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if gone else doc, -score] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60}, {"held": 1}])
def test_ranked_search_against_a_loop(spark, options):
    docs, items = search_fixture()
    left = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, score string, `a.b` int").repartition(5)
    right = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")
    got = Counter(tuple(r) for r in lexical_search.ranked_search(left, right, k=6, **options).collect())
    assert got == plain_search(docs, items, 6)


def test_ranked_search_in_sql(spark):
    docs, items = search_fixture(4, 60)
    table = lambda rows, key: pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    names, want = oracle("op11_lexical_search", documents=table(docs, "doc_id"), benchmark=table(items, "item_id"))
    assert names == ["item_id", "rank", "doc_id", "score"] and want == plain_search(docs, items, 20)


def test_ranked_search_of_empty_tables(spark):
    docs, items = search_fixture()
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for d, i in [(none[0], some[1]), (some[0], none[1]), none]:
        out = lexical_search.ranked_search(d, i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_a_text_longer_than_a_piece():
    text = ("Près-du " * 400_000).encode()
    assert lexical_search.term_counts(text) == {"près".encode(): 400_000, b"du": 400_000}


def test_radix_order_is_stable_beyond_16_bits():
    keys = np.random.default_rng(1).integers(0, 1 << 34, 5000) // (1 << 20) * 7
    assert (lexical_search.radix_order(keys, int(keys.max()) + 1) == np.argsort(keys, kind="stable")).all()


def vector_fixture(seed=5, n=60, length=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = rng.standard_normal(length)
        rows += [(1000 - 10 * i - j, (centre + 0.12 * j * rng.standard_normal(length)).astype(np.float32).tolist(), j % 3 or None) for j in range(rng.integers(1, 5))]
    rows += [(3000 + j, rows[0][1], 5) for j in range(6)]  # copies
    rows += [(4000, [2 * x for x in rows[4][1]], 1), (4001, None, 1), (4002, [], 1), (4003, [0.0] * length, None), (4004, [float("nan")] + [1.0] * (length - 1), 2), (4005, [float("inf")] * length, 2), (4006, [None] + [1.0] * (length - 1), 2)]
    return [*rows, (None, rows[8][1], 1), (rows[9][0], rows[9][1], 1), (rows[9][0], rows[9][1], 1), (None, [0.0] * length, 0), (5000, [1.0, 2.0, 3.0], 4), (5001, [2.0, 4.0, 6.1], 4), (5002, [-1e-38] + [0.0] * (length - 1), 4), (5003, [-1e38] + [0.0] * (length - 1), 4)]


VECTORS = "vec_id long, embedding array<float>, label int, node string, n_links string, `a.b` int"


def plain_good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_near(rows, cosine):
    units = [None if not plain_good(r[1]) else np.float64(np.float32(r[1])) / np.linalg.norm(np.float64(np.float32(r[1]))) for r in rows]
    linked = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine] for i, a in enumerate(units)]
    out = Counter()
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in linked[k] if j not in seen and not seen.add(j)]
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[r[0], len(linked[i]), least, r[0] == least] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"hot_rows": 4}, {"bits": 1, "tables": 3, "hot_rows": 10}])
def test_near_vectors_against_all_pairs(spark, options):
    rows = vector_fixture()
    table = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], VECTORS)
    got = Counter(tuple(r) for r in vector_copies.near_vectors(table, 0.95, **options).collect())
    want = plain_near(rows, 0.95)
    if options:
        assert got == want
    else:  # by the plan of tables, of a pair in a hundred thousand's chance
        assert got.keys() >= {k for k in want} and got == want
    assert sum(r[1] for r in want.elements()) > 60


def test_a_dense_group_is_a_ball_and_not_compared_with_itself(spark):
    """Near copies within half the angle of their centre, some farther, one more group beside them that links in part, and what
    stands alone; against all pairs."""
    rng = np.random.default_rng(11)
    centre, side, far = rng.standard_normal((3, 64))
    beside = centre / np.linalg.norm(centre) + 0.25 * side / np.linalg.norm(side)
    make = lambda c, spread, n: [c / np.linalg.norm(c) + spread * rng.standard_normal(64) / 8 for _ in range(n)]
    vectors = [*make(centre, 0.1, 60), *make(centre, 0.25, 20), *make(beside, 0.08, 40), *make(far, 0.05, 30), *rng.standard_normal((40, 64))]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(vectors)] + [(900 + j, vectors[3].astype(np.float32).tolist(), 1) for j in range(5)]
    table = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], VECTORS)
    want = plain_near(rows, 0.95)
    for hot_rows in (3, 10, 25):
        assert Counter(tuple(r) for r in vector_copies.near_vectors(table, 0.95, hot_rows=hot_rows, bits=3, tables=30).collect()) == want
    nodes = vector_copies.materialise(spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(make(centre, 0.01, 500))], "node long, weight long, vec array<double>"))
    signed = vector_copies.materialise(nodes.mapInArrow(lambda it: vector_copies._signed_rows(it, 4, 5, 12), "node long, weight long, vec binary, signs binary, keys array<long>"))
    balls = vector_copies._balls(signed, 0.95, 50).collect()
    keyed = signed.join(spark.createDataFrame([(r.node, r.ball) for r in balls], "node long, ball long"), "node").select("node", "ball", F.explode("keys").alias("key"))
    cells = vector_copies._in_cells(keyed, 50)
    assert len(balls) >= 450 and cells.groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 2 * 60
    assert len({r.ball for r in balls}) > 1 or cells.count() <= 50  # those of keys that are not hot


def test_near_vectors_in_sql(spark):
    rows = [r for r in vector_fixture() if r[1] is None or len(r[1]) in (0, 3, 16)]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    names, want = oracle("op12_vector_copies", embeddings=table)
    assert names == ["vec_id", "n_links", "component_id", "kept"] and want == plain_near(rows, 0.95)


def test_near_vectors_recall_at_the_stated_cosine():
    """Pairs at exactly 0.95 share a key but for about MISSED; measured over 20,000 pairs with the keys of 50,000 vectors."""
    bits, tables = vector_copies.plan(50_000, 0.95)
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    planes = vector_copies.hyperplanes(64, bits, tables, 12)
    keys = [vector_copies._keys(x @ planes > 0, bits) for x in (a, 0.95 * a + math.sqrt(1 - 0.95**2) * b)]
    met = (keys[0] == keys[1]).any(axis=1)
    assert met.mean() >= 0.9995


def test_near_vectors_of_an_empty_table(spark):
    out = vector_copies.near_vectors(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns == ["vec_id", "n_links", "component_id", "kept"]


def plain_codes(rows, parts, entries, rounds, length):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fits = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in r[1]] for r in fits]
    w = length // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(v[p], p)[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[nearest(v[p], p) for p in range(parts)] for v in cut]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in v) for v in last]
    by = Counter()
    for r, x in zip(fits, error, strict=True):
        by[r[2]] += x
    out = Counter((r[0], "".join(f"{e:02x}" for _, e in v), x, by[r[2]], sha) for r, v, x in zip(fits, last, error, strict=True))
    fit_labels = {r[2] for r in fits}
    return out + Counter((r[0], None, None, by[r[2]] if r[2] in fit_labels else None, sha) for r in kept if len(r[1]) != length)


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (4, 7, 3), (8, 256, 1)])
def test_vector_codes_against_plain_rounds(spark, parts, entries, rounds):
    rows = [*vector_fixture(6), (-9, [1.0, 2.0, 3.0], 1)]  # the least id's vector doesn't fit
    table = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in vector_codes.vector_codes(table, parts, entries, rounds).collect())
    assert got == plain_codes(rows, parts, entries, rounds, 16)


def test_vector_codes_in_sql():
    rows = [r for r in vector_fixture(7, 90) if r[1] is None or len(r[1]) == 16]
    rows = [r for r in rows if r[1] is None or all(x is None or not abs(x) > 1e9 or math.isinf(x) for x in r[1])]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    names, want = oracle("op13_vector_codes", embeddings=table)
    assert names == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and want == plain_codes(rows, 16, 64, 2, 16)


def test_bounds_hold_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(9)
    x, book = rng.integers(-6, 6, (500, 2)), rng.integers(-6, 6, (40, 2))  # many ties and equal entries
    entry, lower = np.zeros(500, np.int64), np.zeros((500, 40))
    upper = np.linalg.norm(x - book[0], axis=1) * (1 + 1e-9)
    for _ in range(3):
        vector_codes.assign(x, book, entry, upper, lower)
        d = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all()
        assert (lower <= np.sqrt(d)).all() and (upper >= np.sqrt(d.min(axis=1))).all()
        moved = book + rng.integers(-1, 2, book.shape)
        step = np.sqrt(((moved - book) ** 2).sum(axis=1)) * (1 + 1e-9)
        book, upper, lower = moved, upper + step[entry], np.maximum(0, lower - step)


def test_vector_codes_of_tables_without_a_vector(spark):
    for rows in ([], [(1, None, 1, "", "", 1)], [(1, [1.0], 1, "", "", 1)]):
        got = [tuple(r) for r in vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()]
        assert got == ([(1, None, None, None, None)] if rows and rows[0][1] else [])
