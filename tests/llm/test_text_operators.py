"""Jaccard join, substring dedup and quality rules against brute force, and their edge cases."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from brute import quality as brute_quality
from brute import repeats as brute_repeats
from brute import similar as brute_similar

from chronofold.llm import jaccard, quality, repeats, tables


def _words(rng, n, of=5000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of one text, a shared passage, repeats, nulls, empty and long texts."""
    rng = random.Random(5)
    texts = [" ".join(_words(rng, rng.randrange(1, 160))) for _ in range(40)]
    base = _words(rng, 150)
    for n in range(60):
        copy = list(base)
        for _ in range(n % 6):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = _words(rng, 57)
    texts += [
        " ".join(_words(rng, 30) + passage + _words(rng, n)) for n in (0, 3, 80) for _ in range(6)
    ]
    texts += [texts[0], texts[0].upper(), texts[3], "", None, " \t\n ", "one", "ONE", "a b c", "a b"]
    texts += ["na " * 400, " ".join(_words(rng, 6000, 10**6)), "x y  z é É", "z\x0bq\x1fr"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(documents, corpus, k, percent):
    got = jaccard.similar(documents(*corpus), k, percent).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(corpus)
    assert found == brute_similar(dict(enumerate(corpus)), k, percent)


def test_components_do_not_depend_on_known_frequencies(documents, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_TOKENS", 3)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 5)
    got = jaccard.similar(documents(*corpus)).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert found == brute_similar(dict(enumerate(corpus)))


def test_threshold_is_exact(documents):
    base = [f"w{i}" for i in range(203)]  # 200 shingles
    at = base[:-15] + [f"v{i}" for i in range(15)]  # 185 in common: 185 / 215 = 0.8605
    below = base[:-17] + [f"u{i}" for i in range(17)]  # 183 in common: 183 / 217 = 0.8433
    got = jaccard.similar(documents(" ".join(base), " ".join(at), " ".join(below))).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2}


def test_groups_of_mixed_sizes_are_opened_for_the_least_need(spark, documents):
    """Leaders have linked nothing with A. Tokens are numbered as they are ordered."""
    a_rare, b_rare, common = range(5), range(10, 21), range(100, 195)
    sets = {
        1: [*a_rare, *common],  # A
        2: [*b_rare, *common],  # B: 95 of 111 tokens are common to both
        3: [*b_rare, *common[:92]],
        4: [*b_rare, 30, *common],
    }
    assert [len(s) for s in sets.values()] == [100, 106, 103, 107]
    shared = [
        (token, cls, len(s)) for cls, s in sets.items() for token in s[: len(s) + 1 - -(-85 * len(s) // 100)]
    ]
    documents()
    asked = jaccard._asked(
        spark.createDataFrame(shared, "token long, cls long, n long"),
        spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 2)], "cls long, root long"),
        85,
    )
    assert [tuple(r) for r in asked.collect()] == [(1, 2, 3)]


@pytest.mark.parametrize("percent", [80, 85])
def test_need_of_a_span_is_that_of_its_ends_or_one_less(percent):
    def least(a, b):
        behind = -(-percent * max(a, b) // 100) - 1
        return max(-(-percent * (a + b) // (100 + percent)) - behind, 1)

    for n in range(1, 140):
        high_most = 100 * n // percent
        for low in range(-(-percent * n // 100), high_most + 1):
            for high in range(low, high_most + 1):
                ends = min(least(n, low), least(n, high))
                need = max(ends - (high - max(low, n) >= 2), 1)
                assert need <= min(least(n, m) for m in range(low, high + 1))


def test_texts_are_read_four_times_at_most(spark, documents, corpus):
    """For the survey and the prefixes, and twice to pick those whose tokens are compared."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = documents(*corpus)
    counted = docs.mapInArrow(count, docs.schema)
    assert len(jaccard.similar(counted).collect()) == len(corpus)
    assert 2 * len(corpus) <= read.value <= 4 * len(corpus)


def test_written_tables_leave_no_shuffle_files(spark):
    """They go soon after the write, not when the driver collects garbage; the setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        every = disk.getAllFiles()
        names = {every.apply(i).getName() for i in range(every.size())}
        return {name for name in names if name.startswith("shuffle_")}

    held, before = files(), spark.conf.get(tables._CLEANUP, None)
    frame = spark.range(1000).selectExpr("id % 10 k").groupBy("k").count()
    assert tables.written(frame, "sums").count() == 10
    assert spark.conf.get(tables._CLEANUP, None) == before
    made = {name.split("_")[1] for name in files() - held}
    end = time.monotonic() + 10
    while len(made) > 1 and time.monotonic() < end:  # one is of the count above
        time.sleep(0.2)
        made = {name.split("_")[1] for name in files() - held}
    assert len(made) <= 1


@pytest.mark.parametrize("known", [0, 3, 60])
def test_prefixes_lead_with_rare_tokens_and_end_with_the_most_frequent(corpus, known):
    texts = [*corpus, "one", None, "w1 w2 w3 w4"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    lists = [row for b in jaccard._token_lists(4)(iter([batch])) for row in b.to_pylist()]
    every = sorted({t % 2**64 for row in lists for t in row["tokens"]})
    common = np.array(every[:: max(len(every) // known, 1)][:known] if known else [], np.uint64)
    place = {int(t): 1 + (i * 7) % 5 for i, t in enumerate(common)}
    rank = np.array([place[int(t)] for t in common], np.int64)
    expected = []
    for row in lists:
        n = len(row["tokens"])
        order = sorted((t % 2**64 for t in row["tokens"]), key=lambda t: (place.get(t, 0), t))
        expected += [(t, row["cls"], n) for t in order[: n and n + 1 - -(-85 * n // 100)]]
    got = [
        (row["token"] % 2**64, row["cls"], row["n"])
        for b in jaccard._prefixes(4, 85, common, rank)(iter([batch]))
        for row in b.to_pylist()
    ]
    assert got == expected and got


def test_empty_tables_null_ids_and_extra_columns(spark, documents, corpus):
    empty = documents(*corpus).limit(0)
    assert jaccard.similar(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert quality.judge(empty).count() == 0
    odd = documents((None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")).selectExpr(
        "*", "1 cls", "2 n", "3 token", "4 anchor", "5 starts", "6 host", "7 row"
    )
    assert [tuple(r) for r in jaccard.similar(odd).collect()] == [(7, 2, 7)] * 2
    removed = repeats.remove_repeats(odd, width=10).select("doc_id", "n_removed", "row.cls")
    assert [tuple(r) for r in removed.collect()] == [(7, 0, 1)] * 2
    assert quality.judge(odd).where("n_words = 5").count() == 3


def test_repeats_match_brute_force(documents, corpus):
    got = repeats.digest(repeats.remove_repeats(documents(*corpus))).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}
    assert found == brute_repeats(dict(enumerate(corpus)))


def test_repeats_with_small_shards_and_windows(documents, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_WORDS", 100)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    got = repeats.digest(repeats.remove_repeats(documents(*corpus), width=12)).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}
    assert found == brute_repeats(dict(enumerate(corpus)), width=12)


def test_repeats_keep_untouched_texts_as_they_are(documents):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = documents(f"a  b\n{passage}", f"{passage}\tend", "x  y\n z", None)
    got = repeats.remove_repeats(docs, rejoin=False).orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"a  b\n{passage}", "end", "x  y\n z", None]


def test_quality_measures(documents, corpus):
    lines = "one two\n\none two\n \none two \nthree\none two"
    texts = [*corpus, lines, "# *x* $%&|<>", "a b c d e a b c d e"]
    got = {r.doc_id: r for r in quality.judge(documents(*texts)).collect()}
    for number, text in enumerate(texts):
        row = got[number]
        want = brute_quality(text)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(row[name] for name in names) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_host_verdicts_shrink_small_hosts(documents):
    rng = random.Random(3)
    good = [" ".join(_words(rng, 40)) for _ in range(60)]
    rows = [(i, t, f"https://www.Good{i % 20}.org/a?b") for i, t in enumerate(good)]
    rows += [(100 + i, "no", "http://bad.example/x") for i in range(40)]
    rows += [(200, good[0], "bad.example"), (201, good[1], None), (202, good[2], "")]
    rows += [(203, "no", "tiny.example"), (204, good[3], "tiny.example"), (205, good[4], "tiny.example")]
    got = {r.doc_id: r for r in quality.judge(documents(*rows)).collect()}
    assert got[200].host_rejected and not got[200].kept  # a clean text of a bad host
    assert got[201].kept and got[202].kept  # host unknown
    assert got[204].kept and not got[203].kept
    assert all(got[i].kept for i in range(60))
