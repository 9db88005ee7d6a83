import hashlib
import math
import random
from collections import Counter

import pytest
from test_llm import FOREIGN, brute_near_classes

import corpus_pipeline
from scene_qa.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, first string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Words of 24 and 5 words: benchmark passages.
ENGLISH = "the water rose over the old bridge while every house near this river waited for help from people in the town above that hill".split()
GERMAN = "das wasser stieg schnell über die alte brücke und jedes haus am fluss wartete auf hilfe aus der stadt hinter dem hügel".split()


def fixture():
    rng = random.Random(12)
    passage, short = rng.choices(ENGLISH, k=24), ["quick", "zebra", "under", "violet", "moon"]
    rows = []
    for i in range(60):
        lang, words = (("en", ENGLISH), ("de", GERMAN))[i % 2]
        text = rng.choices(words, k=rng.randint(30, 90))
        if i in (10, 20):
            text[5:5] = passage if i == 10 else short
        rows.append((i, " ".join(text), lang if i % 7 else None, ("a.org", "b.de", "c", None)[i % 4], len(text)))
    for i in (3, 4, 10):  # exact copies and near copies
        rows.append((100 + i, rows[i][1].upper(), rows[i][2], "b.de", 1))
        rows.append((200 + i, rows[i][1] + " " + rows[i][1].split()[0], rows[i][2], "c", 1))
    rows += [(300, None, "en", "c", None), (301, "", "en", None, 0), (302, "12 34 -- 5", "de", "c", 9), (None, None, None, None, None)]
    rows += [(400 + k, FOREIGN[x], "en", "a.org", 9) for k, x in enumerate(("ru", "ja", "it"))]
    rows += [(303, " ".join(rng.choices(GERMAN, k=20_000)), "de", "a.org", 100_000), rows[1], rows[1], (None, " ".join(rng.choices(ENGLISH, k=50)), "en", "c", 50)]
    return [(*r, "clash", "clash") for r in rows], [(1, " ".join(passage)), (2, " ".join(short)), (3, None), (4, "")]


def copies(doc_id, rate):
    u = int(hashlib.md5(f"17:{'-' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u and n < 1000:
        n += 1
        p *= rate / n
        total += p
    return n


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage, and the last result."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, bench = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
        seen.append([tuple(r) for r in docs.collect()] if docs.columns == COLUMNS else docs.collect())
    return seen


def test_language_stage_drops_texts_without_letters_and_of_other_languages(stages):
    assert {400, 401, 402} <= {r[0] for r in stages[0]}
    assert Counter(stages[1]) == Counter(r for r in stages[0] if any(c.isalpha() for c in r[1] or "") and r[0] not in (400, 401, 402))


def test_near_dedup_stage_against_all_pairs(stages):
    rows = stages[1]
    label = brute_near_classes([r[1] for r in rows], 5, 0.8)
    want = Counter()
    for c in set(label):
        want[min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None)] += 1
    assert Counter(r[0] for r in stages[2]) == want and not Counter(stages[2]) - Counter(rows)


def test_near_copies_with_a_line_repeated(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for pair in range(6):
        body, line = [rng.choice(words) for _ in range(90)], [rng.choice(words) for _ in range(12)]
        rows += [(2 * pair, " ".join(body + line)), (2 * pair + 1, " ".join(body[:-1] + ["other"] + line * 200))]
    label = brute_near_classes([r[1] for r in rows], 5, 0.8)
    assert all(label[2 * k] == label[2 * k + 1] for k in range(6)) and len(set(label)) == 6
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4, 6, 8, 10]


def test_near_copies_against_all_pairs_of_random_texts(spark):
    """Sets of four shingles to some hundreds, lines that repeat, pairs about the threshold."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for n in (8, 9, 12, 20, 45, 90, 160, 300) * 6:
        base = [word() for _ in range(n)]
        line = [word() for _ in range(8)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, n // 60, n // 45])):
                w[rng.choice([0, -1, rng.randrange(n)])] = word()
            rows.append((len(rows), " ".join(w + line * rng.choice([0, 0, 0, 1, 3, 120]))))
    label = brute_near_classes([r[1] for r in rows], 5, 0.8)
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label)) and len(set(label)) < len(rows) - 60


def test_decontamination_stage(stages):
    assert {10, 20} <= {r[0] for r in stages[2]}
    assert Counter(stages[3]) == Counter(r for r in stages[2] if r[0] not in (10, 20))


def test_mixture_stage_against_a_plain_inversion(stages):
    sizes = Counter()
    for r in stages[3]:
        sizes[r[3]] += len(r[1].encode()) + 1
    weights = {s: n**0.7 for s, n in sizes.items()}
    rates = {s: weights[s] * sum(sizes.values()) / sum(weights.values()) / n for s, n in sizes.items()}
    assert Counter(stages[4]) == Counter({r: n for r in stages[3] if (n := copies(r[0], rates[r[3]]))})


def test_sharding_stage_keeps_whole_rows(stages):
    got = stages[5]
    assert Counter(tuple(r)[:-2] for r in got) == Counter(stages[4]) and got[0].__fields__ == [*COLUMNS, "shard", "slot"]
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(16))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
