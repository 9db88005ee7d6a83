import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scene_qa.llm import decontaminate, exact_dedup, hilbert, language, mixture, near_copies, queries, quotation, simhash, substring_dedup, token_count, url_filter

WORDS = ["the", "flood", "road", "water", "près", "gross", "a", "b", "rain", "tree"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _row string"


def fixture_rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(12)]
    rows = [(i, rng.choice(base) + rng.choice(["", "", " x", " Rain"]), rng.choice(["en", "de", None]), rng.choice(["a.de", "b", None]), i) for i in range(n)]
    rows += [(3, rows[3][1], "en", "b", 1), (3, rows[3][1], "en", "b", 1), (None, None, None, None, None), (7, "", "en", "b", None), (None, "road " * 3000, "en", "b", 5)]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA)


def test_exact_groups(docs):
    rows = fixture_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert len(got) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [g for g in got if g[4] == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(g[0] for g in mine) == Counter(ids) and {(g[1], g[2]) for g in mine} == {(keep, len(ids))}
        assert [g[0] for g in mine if g[3]] == [keep]
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, hot_rows=2).collect()) == Counter(got)  # hot texts are dealt
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_simhash_components_and_hot_buckets(docs):
    rows = fixture_rows()
    fps = [simhash.fingerprint((r[1] or "").encode(), 3) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.simhash_components(docs).collect()) == want
    assert Counter(in_duckdb("op5_simhash", documents=(["doc_id"], ["text"], rows))) == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_links_of_hot_buckets_equal_the_plain_search(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 62, 3)) for _ in range(80)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from scene_qa.llm.components import connected_components

    plain, hot, *longer = ({(r.node, r.root) for r in connected_components(simhash.fingerprint_links(df, 3, rows, blocks)).collect()} for rows, blocks in ((10_000, None), (8, None), (10_000, 5), (8, 6)))
    assert plain == hot and plain and all(x == plain for x in longer)
    assert [simhash.blocks_for(n, 3) for n in (10**6, 10**9, 10**12)] == [4, 5, 6]


def test_components_against_a_plain_search(spark):
    from scene_qa.llm.components import connected_components

    rng = random.Random(7)
    pairs = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(5, 5)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    rows = spark.createDataFrame(pairs + pairs[:9], "a long, b long")
    assert sorted(map(tuple, connected_components(rows).collect())) == sorted((x, label[x]) for x in linked)
    assert connected_components(rows.limit(0)).count() == 0


def brute_near_classes(texts, words, similarity):
    """Class (least index) of each text, by all pairs; A-Z lower-cased, as the operator states."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()  # of bytes: only A-Z change
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("hot_bytes", [32 << 20, 3000])
def test_near_copies_against_brute_force(spark, hot_bytes, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for n in (0, 3, 12, 60, 60, 200, 900):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            w = list(base)
            for _ in range(min(edits, n)):
                w[rng.randrange(n)] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(120)]
    texts += [" ".join(base[:k] + [word()] + base[k:]) for k in range(0, 120, 3)]  # a dense group
    texts += [None, "", " \n", texts[30].upper()]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash"), (5, texts[5], "clash"), (None, texts[50], "clash"), (None, word(), "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    links = near_copies.near_copy_links
    monkeypatch.setattr(near_copies, "near_copy_links", lambda nodes, similarity: links(nodes, similarity, hot_bytes=hot_bytes))
    got = near_copies.one_of_each(df)
    label = brute_near_classes([r[1] for r in rows], 5, 0.8)
    want = set()
    for c in set(label):
        ids = [rows[i][0] for i in range(len(rows)) if label[i] == c]
        want.add(min((i for i in ids if i is not None), default=None))
    assert Counter(r.doc_id for r in got.collect()) == Counter(want) and got.columns == df.columns
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_substrings_against_brute_force(docs):
    rows, w = fixture_rows(), 24
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + w] for _, b in texts for i in range(len(b) - w + 1))
    want = Counter()
    for key, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want[key, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    for limit in (1 << 20, 1):
        assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, window=w, core_bytes=limit).collect()) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert not in_duckdb("op6_substring_dedup", documents=(["doc_id"], ["text"], []))
    whole = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert Counter(whole) == Counter(in_duckdb("op6_substring_dedup", documents=(["doc_id"], ["text"], rows))) and any(r[2] for r in whole)


def test_substrings_of_a_very_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2_500_000))
    other = long[1_048_400:1_048_900] + "end"
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, other), (3, "x" * 400)], "doc_id long, text string")).collect()}
    assert [(got[k].n_removed, got[k].n_spans) for k in (1, 2, 3)] == [(500, 1), (500, 1), (400, 1)]


def test_hilbert_law(docs):
    rows = fixture_rows()
    got = hilbert.hilbert_shards(docs, 16).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert hilbert.hilbert_shards(docs.limit(0), 16).count() == 0
    hot = hilbert.hilbert_shards(docs, 16, hot_rows=1).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in hot) == Counter((r.doc_id, r.text_crc32) for r in got)
    for found in (got, hot):  # equal texts stand together: a group is cut only where a shard ends
        order = sorted(found, key=lambda r: (r.shard, r.slot))
        runs = Counter(a.text_crc32 for a, b in zip(order, [None, *order], strict=False) if b is None or a.text_crc32 != b.text_crc32)
        assert set(runs.values()) == {1}


def test_shard_rows_keeps_rows_that_differ_beside_a_null(spark):
    rows = [(1, "text", "a", None, 3), (1, "text", None, "a", 3), (1, "text", None, None, 3), (1, "text", None, None, None), (2, None, None, "a", None), (2, None, "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    assert Counter(tuple(r)[:5] for r in hilbert.shard_rows(df, 4).collect()) == Counter(rows)


def test_near_copies_keep_one_stated_row_of_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", None), (1, text, None, "a"), (1, text, None, None), (2, text, None, None)]
    kept = {tuple(near_copies.one_of_each(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string, lang string").repartition(k + 1)).collect()[0]) for k in range(3)}
    assert len(kept) == 1 and kept <= set(rows[:3])


def test_files_of_shards_are_skipped(spark, tmp_path):
    """A filter on two dimensions meets few of the files, by their own statistics; of a table in order of ids it meets all."""
    import pyarrow.parquet as pq

    rng = random.Random(6)
    rows = [(i, f"text {i}", rng.choice("abcdefghijklmnop"), rng.choice(["de", "en", "es", "fr"]), rng.randrange(10_000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    hilbert.write_shards(df, str(tmp_path / "curve"), 16)
    df.repartitionById(16, (F.col("doc_id") / 250).cast("int")).write.parquet(str(tmp_path / "ids"))

    def met(folder):
        files = sorted((tmp_path / folder).glob("part-*.parquet"))
        hits = []
        for f in files:
            group = pq.ParquetFile(f).metadata.row_group(0)
            span = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
            hits.append(span["lang"].min <= "es" <= span["lang"].max and span["n_chars"].min < 2500 and span["n_chars"].max >= 1000)
        return len(files), sum(hits)

    assert met("ids") == (16, 16) and met("curve")[0] == 16 and met("curve")[1] <= 8
    back = spark.read.parquet(str(tmp_path / "curve"))
    assert Counter(tuple(r)[:5] for r in back.collect()) == Counter(rows)
    assert back.where("lang = 'es' and n_chars >= 1000 and n_chars < 2500").count() == sum(r[3] == "es" and 1000 <= r[4] < 2500 for r in rows)
    for f in sorted((tmp_path / "curve").glob("part-*.parquet")):
        t = pq.read_table(f, columns=["shard", "slot"]).to_pydict()
        assert len(set(t["shard"])) == 1 and t["slot"] == list(range(len(t["slot"])))


def test_hilbert_spreads_few_steps_over_the_curve(spark):
    """Of three languages and many sizes, a shard holds few: the steps of lang reach the curve's upper bits."""
    rng = random.Random(5)
    rows = [(i, f"t{i}", rng.choice("abcdefghijklmnop"), rng.choice(["de", "en", "fr"]), rng.randrange(10_000)) for i in range(2000)]
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), 16).collect()
    lang = {r[0]: r[3] for r in rows}
    assert sum(len({lang[r.doc_id] for r in got if r.shard == s}) for s in range(16)) / 16 <= 2


def test_hilbert_recomputed_plainly(spark, docs):
    """Cells from the cut points, the curve by a plain walk, shards by rank."""
    dims, bits, rows = ["source", "lang", "n_chars"], 3, fixture_rows()
    cuts = hilbert.cut_points(docs, dims, bits)
    step = lambda v, c: 0 if v is None or not c else sum(v >= x for x in c) * (2**bits - 1) // len(c)
    cell = lambda r: tuple(step(v, c) for v, c in zip((r[3], r[2], r[4]), cuts, strict=True))
    grid = spark.createDataFrame([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], "a int, b int, c int")
    index = {(r.a, r.b, r.c): r.h for r in grid.withColumn("h", hilbert.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits)).collect()}
    assert sorted(index.values()) == list(range(512))
    packed = lambda c: (c[0] * 8 + c[1]) * 8 + c[2]
    least = {}
    for r in rows:
        key = r[1] or ""
        least[key] = min(least.get(key, (1 << 30, None)), (packed(cell(r)), cell(r)))
    want = Counter((r[0], zlib.crc32((r[1] or "").encode()), index[least[r[1] or ""][1]]) for r in rows)
    got = hilbert.hilbert_shards(docs, 5, bits=bits, cuts=cuts).collect()
    assert Counter((r.doc_id, r.text_crc32, r.curve) for r in got) == want
    ranked = sorted(want.elements(), key=lambda x: x[2])
    assert [Counter(r.curve for r in got if r.shard == s) for s in range(5)] == [Counter(x[2] for k, x in enumerate(ranked) if k * 5 // len(ranked) == s) for s in range(5)]


@pytest.mark.parametrize("hot_rows", [1, 3])
def test_joins_that_deal_hot_keys_give_the_same_rows(spark, docs, monkeypatch, hot_rows):
    from scene_qa.functions import joins

    pages = spark.createDataFrame([(i, u) for i, u in enumerate([None, "", "http://a.net/x", "https://en.example.net/en/", "no address"] * 4 + ["http://a.net/x"] * 9)], "page_id long, url string")
    runs = {"fingerprints": lambda: simhash.simhash_components(docs), "repeats": lambda: substring_dedup.remove_repeats(docs, window=24), "pages": lambda: url_filter.filter_pages(pages)}
    plain = {k: Counter(tuple(r) for r in f().collect()) for k, f in runs.items()}
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    assert {k: Counter(tuple(r) for r in f().collect()) for k, f in runs.items()} == plain


def test_hilbert_tells_strings_apart_that_share_a_beginning(spark):
    rows = [(i, f"text {i}", f"https://www.site{i % 8}.org/" + "p" * 300 + str(i % 8), "en", 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    cuts = hilbert.cut_points(df, ["source", "n_chars"])
    assert len(cuts[0]) == 8 and all(len(c) > 300 for c in cuts[0])
    got = hilbert.hilbert_shards(df, 8, dims=("source", "n_chars")).collect()
    source = {r[0]: r[2] for r in rows}
    assert all(len({source[r.doc_id] for r in got if r.shard == s}) == 1 for s in range(8))


def test_shard_rows_returns_whole_rows(spark, docs):
    rows = fixture_rows()
    got = hilbert.shard_rows(docs, 8)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    found = [tuple(r) for r in got.collect()]
    at = docs.columns.index("shard")
    assert Counter(r[:-2] for r in found) == Counter(r[:at] + r[at + 1 :] for r in rows)
    sizes = Counter(r[-2] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r[-1] for r in found if r[-2] == s) == list(range(sizes[s])) for s in range(8))
    plain = Counter((r.doc_id, r.shard, r.slot) for r in hilbert.hilbert_shards(docs, 8).collect())
    assert Counter((r[0], r[-2], r[-1]) for r in found) == plain
    assert hilbert.shard_rows(docs.limit(0)).count() == 0


def test_hilbert_curve_steps_by_one(spark):
    rows = spark.range(512).select(*[F.shiftrightunsigned("id", 3 * i).bitwiseAND(F.lit(7)).cast("int").alias(f"x{i}") for i in range(3)])
    path = sorted((r.h, r.x0, r.x1, r.x2) for r in rows.withColumn("h", hilbert.hilbert_index([F.col("x0"), F.col("x1"), F.col("x2")], 3)).collect())
    assert [p[0] for p in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_token_counts_equal_the_tokenizer():
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    rng = random.Random(4)
    vocab = [("<unk>", 0.0), *{("".join(rng.choices("▁abc", k=rng.randint(1, 4))), -float(rng.randint(1, 6))) for _ in range(60)}]
    vocab = list(dict(vocab).items())
    tok = Tokenizer(models.Unigram(vocab, 0, False))
    tok.normalizer = normalizers.Sequence([normalizers.Replace(Regex(r"[\x09-\x0d ]+"), " "), normalizers.Replace(Regex("^ +| +$"), "")])
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocab)
    for _ in range(300):
        text = "".join(rng.choices("aabbcc dé", k=rng.randint(1, 30)))
        assert counter.text(text.encode())[0] == len(tok.encode(text).ids), text
    assert counter.text(b"  ") == (0, 0.0)


def plain_counts(vocabulary, text):
    """Pieces and score by trying all pieces at all places, character by character; of equal scores the longest last piece."""
    scores = dict(vocabulary)
    unknown, pieces, total = min(scores.values()) - 10, 0, 0.0
    for w in (text or "").encode().split():
        w = "▁" + w.decode().replace(" ", "▁")
        best = [(0.0, 0, False)] + [(-math.inf, 0, False)] * len(w)
        for end in range(1, len(w) + 1):
            for size in range(end, 0, -1):
                piece, before = w[end - size : end], best[end - size]
                if piece in scores and before[0] + scores[piece] > best[end][0]:
                    best[end] = before[0] + scores[piece], before[1] + 1, False
            if w[end - 1] not in scores and best[end - 1][0] + unknown > best[end][0]:
                best[end] = best[end - 1][0] + unknown, best[end - 1][1] + (not best[end - 1][2]), True
        pieces, total = pieces + best[-1][1], total + best[-1][0]
    return pieces, total


def test_token_count_query_against_all_pieces(spark):
    rng = random.Random(4)
    vocab = list({"".join(rng.choices("▁abcdé", k=rng.randint(1, 4))): -float(rng.randint(1, 6)) for _ in range(80)}.items())
    texts = ["".join(rng.choices("aabbccddé xX", k=rng.randint(1, 60))) for _ in range(80)] + [None, "", " \n\t", "abc " * 30_000, "a" * 3000, "▁a ▁▁"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, texts[4], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, data string, score long")
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6), r.n_bytes) for r in token_count.token_counts(df, vocab).collect())
    assert got == Counter((r[0], *(lambda p: (p[0], round(p[1], 6)))(plain_counts(vocab, r[1])), len((r[1] or "").encode())) for r in rows)
    assert token_count.token_counts(df.limit(0), vocab).count() == 0


def test_scores_of_a_vocabulary_file():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    own, zipf = token_count.unigram_vocabulary(path), token_count.zipf_vocabulary(path)
    assert [p for p, _ in own] == [p for p, _ in zipf] and len({s for _, s in own}) > 1000
    assert all(a[1] > b[1] for a, b in zip(zipf, zipf[1:], strict=False))


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_passages(item, words):
    """(matches, start, end) of each diagonal's best passage, by the stated rule, over all stretches."""
    need = 13 if len(item) > 16 else max(1, math.ceil(0.8 * len(item) - 1e-9))
    for shift in range(-len(item) + 1, len(words)):
        same = {k + shift: item[k] == words[k + shift] for k in range(len(item)) if 0 <= k + shift < len(words)}
        hits = [p for p, x in same.items() if x]
        if len(item) <= 16:
            best = (len(hits), hits[0], hits[-1] + 1) if hits else (0, 0, 0)
        else:
            score = lambda a, b: sum(1 if same[p] else -2 for p in range(a, b))
            stretches = [(a, b) for a in hits for b in [h + 1 for h in hits] if a < b]
            best = max(((score(a, b), sum(same[p] for p in range(a, b)), -a, -b) for a, b in stretches), default=(0, 0, 0, 0))
            best = (best[1], -best[2], -best[3])
        if best[0] >= need:
            yield best


def decontamination_fixture():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [word() for _ in range(12)]
    sizes = [1, 3, 5, 8, 9, 12, 13, 15, 16, 17, 20, 30, 45]
    items = [[rng.choice(common) if rng.random() < 0.2 else word() for _ in range(n)] for n in sizes]
    rows = []
    for k in range(150):
        w = [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randrange(3)):
            item = list(rng.choice(items))
            for p in range(len(item)):
                if rng.random() < rng.choice([0, 0.05, 0.15]):
                    item[p] = word()
            a, b = (0, len(item)) if rng.random() < 0.7 else sorted((rng.randint(0, len(item)), rng.randint(0, len(item))))
            at = rng.randint(0, len(w))
            w[at:at] = item[a:b]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(w).title() if k % 3 else " ".join(w)))
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, " -- "), (903, "filler " * 30_000 + " ".join(items[-1])), (904, " ".join(items[11] + ["gap"] + items[11]))]
    bench = [(100 + k, " ".join(w)) for k, w in enumerate(items)] + [(100, " ".join(items[0])), (113, " ".join(items[11])), (None, " ".join(items[10])), (200, None), (201, "?!")]
    return rows, bench


def in_duckdb(query, **tables):
    """The rows of a query's oracle over tables of (names of long columns, names of string columns, rows)."""
    con = duckdb.connect()
    for name, (longs, strings, rows) in tables.items():
        kinds = [(c, pa.int64()) for c in longs] + [(c, pa.string()) for c in strings]
        con.register(name, pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds)}))
    return con.execute(queries.oracle_sql()[query]).fetchall()


def test_decontamination_against_all_diagonals(spark):
    rows, bench = decontamination_fixture()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, item_id string, r long")
    items = spark.createDataFrame([(*r, 5) for r in bench], "item_id long, text string, k long")
    got = [tuple(r) for r in decontaminate.contaminated(docs, items).collect()]
    joined = [tuple(r) for r in decontaminate.contaminated(docs, items, index_bytes=0).collect()]
    assert Counter(got) == Counter(joined)
    assert Counter(got) == Counter(in_duckdb("op7_decontamination", documents=(["doc_id"], ["text"], rows), benchmark=(["item_id"], ["text"], bench)))
    want = Counter()
    for key, text in rows:
        for item, body in bench:
            w = plain_words(body)
            found = sorted(plain_passages(w, plain_words(text)), key=lambda o: (-o[0], o[1], o[2])) if w else []
            if found:
                want[key, item, found[0][0], len(w), found[0][1], found[0][2]] += 1
    assert all(n <= want[r] for r, n in Counter(got).items() if r[3] <= 16)
    pairs, all_pairs = Counter(r[:2] for r in got), Counter(r[:2] for r in want.elements())
    short = Counter(r[:2] for r in want.elements() if r[3] <= 16)
    assert not short - pairs  # short items miss nothing
    assert not pairs - all_pairs and sum((pairs & all_pairs).values()) >= 0.99 * sum(all_pairs.values())
    bad = {key for key, _ in pairs}
    for limit in (decontaminate.INDEX_BYTES, 0):
        kept = decontaminate.clean(docs, items, index_bytes=limit)
        assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in rows if k not in bad)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontaminate.contaminated(a, b).count() == decontaminate.contaminated(a, b, index_bytes=-1).count() == 0
        assert decontaminate.clean(a, b).count() == a.count()


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    from scene_qa.llm import words

    rng = random.Random(1)
    text = "".join(rng.choices("abcXYZ é.\n", k=5000)).encode() + b"q" * 9000 + b" end"
    for inside, pattern in ((words.LETTERS, rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), (words.NOT_SPACE, rb"[^\x20\x09-\x0d]+")):
        found = re.findall(pattern, text.lower())
        whole = words.word_hashes(text, inside)
        assert len(found) == len(whole) and len(set(found)) == len(set(whole.tolist()))
        assert dict(zip(found, whole.tolist(), strict=True)) == {w: int(words.word_hashes(w, inside)[0]) for w in set(found)}
        monkeypatch.setattr(words, "_CHUNK", 64)
        assert (words.word_hashes(text, inside) == whole).all()
        monkeypatch.undo()


def test_quotes_of_many_lengths_link_by_their_first_lines(spark):
    """A message of 400 lines, and replies that quote a run of it of every length from 2 to 200, some changed in one line."""
    lines = [f"line {i} of the first message" for i in range(400)]
    rows, want = [(1, 0, "a", "\n".join(lines))], {0: None}
    for n in range(2, 201):
        quoted = lines[n : 2 * n]
        if n % 5 == 0:
            quoted = [*quoted[:-1], "changed"]
        rows.append((1, n, "b", "\n".join(f"> {x}" for x in quoted) + f"\nreply {n}"))
        want[n] = 0 if n % 5 else None
    got = quotation.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.reply_to for r in got} == want


def test_quotation_linking(spark):
    rows = [(1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "> Hello  there\nFine."), (1, 2, "a", "Other topic"), (1, 3, "a", "> Fine.\n> > hello there\nGood."), (1, 4, "b", None), (None, None, None, None), (1, 5, "c", "> never said\nx")]
    got = {r.turn: r for r in quotation.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.conv_id == 1}
    assert [got[t].reply_to for t in range(6)] == [None, 0, None, 1, None, None]
    assert [got[t].position for t in (0, 1, 3, 2, 4, 5)] == [0, 1, 2, 3, 4, 5]
    assert got[3].depth == 2 and got[3].root == 0 and got[3].text == "Good." and got[3].n_linked == 2 and got[5].n_linked == 0


def test_quotation_of_a_part_of_a_message(spark):
    five = "line one\nline two\nline three\nline four\nline five"
    rows = [
        (0, "Intro\n" + five + "\nEnd"),
        (1, "First paragraph\n\nSecond paragraph\n\nThird paragraph"),
        (2, "> line  two\n> LINE three\nYes."),  # two lines of a paragraph
        (3, "> Second paragraph\n>\n> Third paragraph\nNo."),  # two of three paragraphs
        (4, "> line two\n> line four\nnot in sequence"),
        (5, "> line three\n> line two\nnot in order"),
        (6, "line two\nline three"),
        (7, "> line two\n> line three\nthe earliest, though a later turn is equal"),
        (8, "> > line four\n> > line five\n> never said\nof a lower level nothing links"),
        (9, "> line five\n> End\n\n> First paragraph\n> more\none of two"),
        (10, "> line one line two\none line over two\n> line two line\npart of a line"),
    ]
    got = {r.turn: r for r in quotation.reply_order(spark.createDataFrame([(1, t, "a", x) for t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(11)] == [None, None, 0, 1, None, None, None, 0, 0, 0, None]
    assert [(got[t].n_quotes, got[t].n_linked) for t in (2, 3, 4, 8, 9)] == [(1, 1), (1, 1), (1, 0), (2, 1), (2, 1)]
    assert [got[t].depth for t in (2, 3, 4)] == [1, 1, 0] and got[3].root == 1 and got[3].position > got[1].position


def plain_threads(rows):
    """(turn -> reply_to, root, depth, and the counts of each row's quotes), by looking at all pairs of messages."""
    normal = lambda s: re.sub(r"[ \t\n\r\x0b\x0c]+", " ", s).strip(" ").translate({c: c + 32 for c in range(65, 91)})
    parsed = []
    for turn, text in rows:
        own, quotes = [[]], []
        last = 0
        for line in (text or "").split("\n"):
            mark = re.match(r"^(?:[ \t]{0,3}>)+ ?", line)
            level, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
            if level:
                if quotes and last == level:
                    quotes[-1][1].append(body)
                else:
                    quotes.append((level, [body]))
                    own.append([])
            elif body.strip():
                own[-1].append(body)
            else:
                own += [[], [body], []]
            last = level
        lines = [line for part in own for line in part]
        units = {normal("\n".join(part)) for part in own} | {normal(x) for x in lines} | {normal("\n".join(lines))}
        parsed.append((turn, units - {""}, [normal(x) for x in lines if normal(x)], [(level, normal("\n".join(q)), [normal(x) for x in q if normal(x)]) for level, q in quotes if normal("\n".join(q))]))

    def original(whole, lines, before):
        held = lambda units, own: whole in units or (len(lines) > 1 and any(own[i : i + len(lines)] == lines for i in range(len(own))))
        turns = [t for t, units, own, _ in parsed if t is not None and held(units, own) and t < before]
        return min(turns, default=None)

    links, counts = {}, []
    for turn, _, _, quotes in parsed:
        found = [original(w, lines, turn) if turn is not None else None for _, w, lines in quotes]
        counts.append((turn, len(quotes), sum(f is not None for f in found)))
        for at, ((level, *_), f) in enumerate(zip(quotes, found, strict=True)):
            if f is not None:
                links.setdefault(turn, []).append((level, at, f))
    parent = {t: min(found)[2] for t, found in links.items()}

    def root(t):
        return (t, 0) if t not in parent else (root(parent[t])[0], root(parent[t])[1] + 1)

    return parent, root, counts


def test_threads_against_all_pairs_of_messages(spark):
    rng = random.Random(20)
    said = [f"sentence {i} about {rng.choice(WORDS)}" for i in range(14)] + ["ok", "Yes."]
    rows = []
    for conv in range(25):
        turns = []
        for turn in range(rng.randint(1, 9)):
            lines = [x for _ in range(rng.randint(1, 3)) for x in [rng.choice(said)] * 1 + ([""] if rng.random() < 0.3 else [])]
            for _ in range(rng.randrange(3)):
                if turns:
                    source = (rng.choice(turns)[1] or "").split("\n")
                    a = rng.randrange(len(source))
                    quoted = source[a : a + rng.randint(1, 4)] if rng.random() < 0.8 else [rng.choice(said)]
                    mark = rng.choice(["> ", ">", "> > ", " > "])
                    lines[rng.randint(0, len(lines)) : 0] = [mark + x.replace(" ", rng.choice([" ", "  "])).upper() for x in quoted]
            turns.append((turn, "\n".join(lines)))
        if conv % 5 == 0:
            turns += [(turns[0][0], turns[0][1]), (turns[-1][0], "> " + said[0]), (None, "> " + said[1]), (99, None), (98, "> " + said[2] + "\n" * 5 + "word " * 20_000)]
        rows += [(None if conv == 24 else conv, t, "user", x, "clash", "clash") for t, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, tk string")
    got = quotation.reply_order(df).collect()
    assert len(got) == len(rows) and sum(r.n_linked for r in got) > 30
    # rows of one turn may stand in any order
    but_place = lambda found: Counter((*r[:1], *r[2:]) for r in map(tuple, found))
    assert but_place(got) == but_place(in_duckdb("op8_quotation_linking", conversations=(["conv_id", "turn"], ["role", "text"], rows)))
    for conv in {r[0] for r in rows}:
        mine = [r for r in got if r.conv_id == conv]
        parent, root, counts = plain_threads([(r[1], r[3]) for r in rows if r[0] == conv])
        assert Counter((r.turn, r.n_quotes, r.n_linked) for r in mine) == Counter(counts)
        for r in mine:
            assert r.reply_to == parent.get(r.turn) and (r.turn is None or (r.root, r.depth) == root(r.turn)), r
            assert not any(re.match(r"^[ \t]{0,3}>", line) for line in r.text.split("\n"))
        order = sorted(mine, key=lambda r: r.position)
        assert [r.position for r in order] == list(range(len(mine)))
        keys = [(-1 if r.turn is None else r.root, -1 if r.turn is None else r.turn) for r in order]
        assert keys == sorted(keys)
    assert quotation.reply_order(df.limit(0)).count() == 0


FOREIGN = {
    "it": "La mattina seguente il fiume era salito oltre la strada e gli abitanti del paese guardavano dalle finestre mentre i pompieri portavano via le persone anziane con le barche",
    "ru": "На следующее утро река поднялась выше дороги и жители деревни смотрели из окон как пожарные увозили пожилых людей на лодках",
    "ja": "翌朝、川は道路を越えて水位が上がり、村の住民は窓から消防士が夜のうちに到着したボートで高齢者を運び出すのを見守っていた",
    "pl": "Następnego ranka rzeka podniosła się ponad drogę a mieszkańcy wsi patrzyli z okien jak strażacy wywozili starszych ludzi łodziami",
    "junk": "xkq zvw qqpl wrtz mnbv lkjh qwrt zxcv pqrs vbnm ghjk dfgh xkcd zqwp jhgf wsxz",
}


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out(given):
    got = language.identify(given, language.cross_fit(given), declared=None, host=None).select("_row.lang", "_row.text", "language", "accepted").collect()
    lettered = [r for r in got if any(c.isalpha() for c in r.text or "")]
    assert sum(r.lang == r.language for r in lettered) / len(lettered) > 0.97
    assert all(r.accepted for r in lettered) and not any(r.accepted for r in got if r not in lettered)


def test_other_languages_are_rejected(spark, given):
    model = language.fit(given)
    rows = spark.createDataFrame([(k, t, "en") for k, t in FOREIGN.items()], "doc_id string, text string, lang string")
    for declared in (None, "lang"):
        assert not any(r.accepted for r in language.identify(rows, model, declared=declared, host=None).collect())


def test_fusion_against_the_formula(spark, given):
    model = language.fit(given, rows=20)
    rng = random.Random(2)
    hosts, said = ["a.de", "b.de", "c.fr", "plain", None, "A.de"], ["de", "en-US", "fr", "it", "", None]
    texts = [r.text for r in given.limit(40).collect()] + [FOREIGN["it"][:12], "", None, "12 34", "e"]
    rows = [(i, rng.choice(texts), rng.choice(said), rng.choice(hosts), "clash", "clash") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, declared string, host string")
    got = {r.doc_id: r for r in language.identify(df, model).select("_row.doc_id", "language", "posterior", "accepted").collect()}
    langs = model.languages
    word = lambda s: (re.match(r"\s*([A-Za-z]+)", s or "") or [None, ""])[1].lower()
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    low = lambda h: None if h is None else h.lower()
    for i, text, lang, host, *_ in rows:
        mine = word(lang)
        others = [(word(r[2]), low(r[3])) for r in rows if r[0] != i and word(r[2]) in langs]
        tally = lambda keep: [sum(d == x for d, h in others if keep(h)) for x in langs]
        share = lambda counts, weight, prior: [(c + weight * p) / (sum(counts) + weight) for c, p in zip(counts, prior, strict=True)]
        everything = tally(lambda h: True)
        base = [(c + 1) / (sum(everything) + len(langs)) for c in everything]
        by_suffix = share(tally(lambda h: suffix(h) == suffix(low(host))) if suffix(low(host)) else [0] * 4, 50.0, base)
        by_host = share(tally(lambda h: h == low(host)) if host else [0] * 4, 20.0, by_suffix)
        like = language.text_log_likelihood(model, (text or "").encode())
        logs = [math.log(p * 0.99) + t + (math.log(0.85 if mine == x else 0.05) if mine in langs else 0) for p, t, x in zip(by_host, like, langs, strict=False)]
        logs.append(math.log(0.01) + like[-1] + (math.log(0.25) if mine in langs else 0))
        scale = sum(math.exp(x - max(logs)) for x in logs)
        best = max(range(4), key=lambda k: (logs[k], -k))
        posterior = math.exp(logs[best] - max(logs)) / scale
        assert got[i].language == langs[best] and got[i].posterior == pytest.approx(posterior, abs=1e-6)
        assert got[i].accepted == (posterior >= 0.5 and any(c.isalpha() for c in text or "")), (i, text)
    assert language.identify(df.limit(0), model).count() == 0


def test_equal_posteriors_and_an_unfitted_model(spark, given):
    model = language.fit(given.limit(0))
    got = language.identify(spark.createDataFrame([(1, "abc"), (1, "abc"), (2, None)], "doc_id long, text string"), model, declared=None, host=None).collect()
    assert Counter((r.language, round(r.posterior, 9), r.accepted) for r in got) == {("de", 0.25, False): 2, ("de", 0.2475, False): 1}


def test_evidence_that_conflicts(spark, given):
    """A text in one language whose markup and host say another: clear text outweighs the declaration, a word or two does not."""
    model = language.fit(given)
    long = " ".join(r.text for r in given.where("lang = 'de' and text is not null").orderBy("doc_id").limit(3).collect())
    rows = [(1, long, "en", "a.com"), (2, long, "de", "a.de"), (3, "", "en", "a.com"), (4, "ok", "fr", "b.fr"), (5, "ok", "es", "b.es")]
    got = {r["_row"].doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()}
    assert got[1].language == got[2].language == "de" and got[2].posterior >= got[1].posterior and got[1].accepted
    assert got[3].language == "en" and not got[3].accepted  # no letter: the declaration is all there is
    assert got[4].language == "fr" and got[5].language == "es"


def test_a_large_rule_set_is_joined(spark):
    """Beyond max_rules the rules are joined by a shuffle on their tokens: the same matches."""
    rng = random.Random(2)
    words = [f"word{k}" for k in range(40)]
    rules = tuple(url_filter.Rule(f"r{k}", f"^{a}/(.*/)?{b}$" if k % 2 else f"(^|/){b}(/|$)", (a, b) if k % 2 else (b,), "block", k % 5) for k, (a, b) in enumerate((rng.choice(words), rng.choice(words)) for _ in range(120)))
    table = url_filter.rule_table(spark, rules)
    subjects = spark.createDataFrame([(x,) for x in {"/".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)}], "subject string")
    small, large = (Counter((r.subject, tuple(r.best)) for r in url_filter.matches(subjects, table, max_rules=n).collect()) for n in (1000, 0))
    want = Counter()
    for r in subjects.collect():
        hits = [(x.rank, -k, x.name, x.action) for k, x in enumerate(rules) if re.search(x.pattern, r.subject)]
        if hits:
            want[r.subject, max(hits)] += 1
    assert small == large == want and want


def test_markup_evidence(spark):
    pages = [
        (1, "https://A.Example.de/x?y", '<HTML data-x=1 lang="de-AT"><style>p{}</style><p>Guten&nbsp;Tag<!-- weg --><script>var en="</p>";</script> heute</p>'),
        (2, "nothing", "<html lang=fr>bonjour"),
        (3, None, None),
        (4, "http://b.org#c", "<p lang='en'>no root language"),
    ]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, text string, lang string")
    got = {r.id: r for r in language.markup_evidence(df).select("_row.page_id", "text", "lang", "source").withColumnRenamed("page_id", "id").collect()}
    assert got[1].text.split() == ["Guten", "Tag", "heute"] and (got[1].lang, got[1].source) == ("de-AT", "A.Example.de")
    assert (got[2].lang, got[2].text.strip(), got[2].source) == ("fr", "bonjour", "") and (got[3].text, got[3].lang, got[3].source) == ("", "", "")
    assert (got[4].lang, got[4].source) == ("", "b.org")


def test_page_language_query(spark):
    from scene_qa.llm.queries import page_language

    sf = "/root/testdata/sf0.001"
    got = page_language(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        declared = re.search(r'<html lang="([a-z]+)"', pages[r.page_id].html)
        assert r.declared == (declared[1] if declared else "")
    # the address's first folder names the language of a page
    named = [(r, m[1]) for r in got if (m := re.match(r"https?://[^/]*/(de|en|es|fr)/", pages[r.page_id].url or ""))]
    assert len(named) > 20 and sum(r.language == lang and r.accepted for r, lang in named) / len(named) > 0.95


def test_mixture_rates(spark, docs):
    got = mixture.mix(docs, counts=True).collect()
    rates = {r.source: r.rate for r in got}
    assert all(r.copies > r.copy for r in got) and rates
    weights = spark.createDataFrame([("b", 1.0)], "source string, weight double")
    assert {r.source for r in mixture.mix(docs, weights=weights).collect()} == {"b"}
    split = spark.createDataFrame([("b", 0.5), ("a.de", 1.0), ("b", 0.5), (None, 0.25), (None, 0.75), ("none", 9.0), ("b", None), ("b", -3.0)], "source string, weight double")
    whole = spark.createDataFrame([("b", 1.0), ("a.de", 1.0), (None, 1.0)], "source string, weight double")
    one, two = ({(r.source, round(r.rate, 9)) for r in mixture.repetition_rates(docs, weights=w).collect()} for w in (split, whole))
    assert one == two and len(one) == 3
    assert mixture.mix(docs.limit(0)).count() == 0
    assert mixture.mix(docs).columns == docs.columns
    from scene_qa.llm.common import pack

    at = [r["_at"] for r in mixture._in_order(pack(docs).withColumn("_at", F.xxhash64("_row")), F.col("_row.doc_id")).select("_at").collect()]
    assert at == sorted(at) and len(at) == docs.count()  # the partitions follow one another


def test_poisson_tables_of_large_rates(spark):
    """Beyond 745 the first probability is 0 in a double; the rest of the table still holds."""
    for rate in (0.3, 700.0, 2000.0):
        got = spark.createDataFrame([(rate,)], "rate double").select(mixture.poisson_cdf(F.col("rate"))).first()[0]
        plain = np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(got))])
        assert len(got) > rate and np.abs(np.array(got) - plain).max() < 1e-10


def test_url_rules(spark):
    urls = ["https://Example.NET/en/1", "http://a.example.com/de/x?y", "ftp://b.org/fr/", "nothing", None, "http://x.net", "http://www.cheap-pills.com/a", "http://cheap-pillsx.com/"]
    got = {r.page_id: r for r in url_filter.filter_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(8)] == ["example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(8)] == ["allow", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert (got[3].host, got[4].path, got[0].host) == ("", "", "example.net")


def test_url_rules_of_odd_tables(spark):
    long = "http://x.com/" + "a/" * 50_000 + "cheap-pills/"
    urls = [long, long, "http://y.com/Cheap-Pills/", "http://example.net/en", "http://notexample.net/en/", "://", "http://A.NET"]
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)] + [(0, long, "clash", "clash", "clash")], "page_id long, url string, host string, rule string, subject string")
    got = url_filter.filter_pages(df).collect()
    assert Counter(r.page_id for r in got) == {0: 2, **{i: 1 for i in range(1, 7)}}
    by = {r.page_id: (r.verdict, r.rule, r.pattern) for r in got}
    assert by[0] == by[1] == ("block", None, "^cheap-pills^") and by[2] == ("allow", None, None)
    assert by[3] == by[4] == ("block", "net/", None) and by[5] == by[6] == ("allow", None, None)
    assert url_filter.filter_pages(df.limit(0)).count() == 0


def test_column_names_with_dots_and_ticks(spark):
    names = {"doc_id": "my.id", "text": "the `text`", "source": "so.urce", "lang": "la.ng"}
    rows = spark.createDataFrame([(r[0], r[1], r[2], r[3], 1) for r in fixture_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    odd = rows.select(*[rows[c].alias(names.get(c, c)) for c in rows.columns])
    two = {k: names[k] for k in ("doc_id", "text")}
    same = lambda a, b: Counter(map(str, (tuple(r) for r in a.collect()))) == Counter(map(str, (tuple(r) for r in b.collect())))
    assert same(exact_dedup.exact_groups(odd, **two), exact_dedup.exact_groups(rows))
    assert same(simhash.simhash_components(odd, **two), simhash.simhash_components(rows))
    assert same(substring_dedup.remove_repeats(odd, window=24, **two), substring_dedup.remove_repeats(rows, window=24))
    assert same(mixture.mix(odd, source="so.urce", counts=True, **two), mixture.mix(rows, counts=True))
    assert same(hilbert.hilbert_shards(odd, dims=("so.urce", "la.ng", "n_chars"), **two), hilbert.hilbert_shards(rows))
    bench = spark.createDataFrame([(1, "the flood road water près gross a b rain tree the flood road water")], "item_id long, text string")
    assert same(decontaminate.contaminated(odd, bench, **two), decontaminate.contaminated(rows, bench))
    turns = rows.select((F.col("doc_id") % 3).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")
    dotted = {"conv_id": "co.nv", "turn": "tu.rn", "role": "ro`le", "text": "te.xt"}
    assert same(quotation.reply_order(turns.select(*[turns[c].alias(n) for c, n in dotted.items()]), **dotted), quotation.reply_order(turns))
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert same(url_filter.filter_pages(pages.select(F.col("page_id").alias("pa.ge"), F.col("url").alias("u.rl")), "pa.ge", "u.rl"), url_filter.filter_pages(pages))
    model, drop = language.fit(rows), lambda df: df.drop("_row")
    assert same(drop(language.identify(odd, model, text=names["text"], declared="la.ng", host="so.urce", key="my.id")), drop(language.identify(rows, model)))
    assert same(near_copies.one_of_each(odd, **two), near_copies.one_of_each(rows))
    vocabulary = [("▁", -1.0), ("a", -2.0)]
    assert same(token_count.token_counts(odd, vocabulary, **two), token_count.token_counts(rows, vocabulary))


def test_cut_points_of_strings_are_quantiles_of_all_rows(spark):
    """More rows than any sample had, nulls, and one value that spans several places."""
    name = lambda i: None if i % 7 == 0 else "hot" if i % 5 == 0 else f"w{i * 7919 % 50_000:05d}"
    df = spark.createDataFrame([(i, name(i), f"l{i % 3}") for i in range(50_000)], "doc_id long, source string, lang string")
    want = []
    for values in (sorted(v for v in map(name, range(50_000)) if v is not None), sorted(f"l{i % 3}" for i in range(50_000))):
        want.append(sorted({values[k * len(values) // 32] for k in range(1, 32)}))
    assert hilbert.cut_points(df, ["source", "lang"]) == want
    assert hilbert.cut_points(df.limit(0), ["source", "lang"]) == [[], []]
