"""The word trigrams of the quality stage: equality with counters, and texts in a wrong word order."""

from __future__ import annotations

import math
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from haulmark.llm import decontaminate, quality, word_trigrams  # noqa: E402
from haulmark.llm.common import AS_WRITTEN, Words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def chain(rng: random.Random, words: list[str], follow: list[list[int]], n: int) -> str:
    """A text whose words each have four that may follow them."""
    at, out = rng.randrange(len(words)), []
    for _ in range(n):
        out.append(words[at])
        at = follow[at][rng.randrange(4)]
    return " ".join(out)


def language(seed: int, size: int = 200) -> tuple[list[str], list[list[int]]]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 11))) for _ in range(size)]
    return words, [[rng.randrange(size) for _ in range(4)] for _ in words]


def off(discounts: np.ndarray, n: int) -> float:
    return float(discounts[min(n, 3)])


def brute(rows: list[tuple], frequent: int, part) -> dict[int, float]:
    """Log perplexities from counters of all texts but one."""
    read, counts = {}, defaultdict(Counter)
    for d, content, lang in rows:
        words = Words(pa.array([content or ""]), AS_WRITTEN)
        read[d] = lang, (content or "").split(), quality.units(words).tolist()
        counts[lang].update(read[d][1])
    top = sorted(((n, lang, w) for lang in counts for w, n in counts[lang].items() if n > 1), key=lambda x: -x[0])[:frequent]
    top = {x[1:] for x in top}
    texts, share = {}, defaultdict(Counter)
    for d, (lang, words, unit) in read.items():
        texts[d] = lang, [(lang, w) if (lang, w) in top else (lang, u) for w, u in zip(words, unit, strict=True)]
        share[lang].update(texts[d][1])
    own = {d: Counter(zip(c, c[1:], c[2:], strict=False)) for d, (_, c) in texts.items()}
    all_ = sum(own.values(), Counter())
    off3 = quality.discounts(np.array(list(all_.values()) or [0]))
    off2 = quality.discounts(np.array(list(Counter((part(u, v), w) for u, v, w in all_).values()) or [0]))
    out = {}
    for d, (lang, _) in texts.items():
        rest = Counter({t: n - own[d][t] for t, n in all_.items() if n > own[d][t]})
        after, before = defaultdict(dict), defaultdict(Counter)
        for (u, v, w), n in rest.items():
            after[u, v][w] = n
            before[part(u, v)][w] += 1
        # discounts are taken from what all texts hold of the same grams
        logs = 0.0
        for (u, v, w), k in own[d].items():
            p = share[lang][w] / sum(share[lang].values())
            for off_, seen in ((off2, before.get(part(u, v))), (off3, after.get((u, v)))):
                if seen:
                    mass = sum(off(off_, n) for n in seen.values())
                    n = seen.get(w, 0)
                    p = (n - off(off_, n) + mass * p) / sum(seen.values())
            logs += k * math.log(p)
        out[d] = -logs / own[d].total() if own[d] else None
    return out


@pytest.mark.parametrize("frequent", [0, 1000])
def test_word_log_perplexity_equals_counters(spark, monkeypatch, frequent):
    rng = random.Random(1)
    langs = {lang: language(i, 40) for i, lang in enumerate(["x", "y", None])}
    rows = [(i, chain(rng, *langs[lang := rng.choice(["x", "y", None])], rng.randrange(1, 120)), lang) for i in range(60)]
    rows += [(200, None, "x"), (201, "", None), (202, "One two", "z"), (203, "Alone in. its lang*", "z")]
    # one bucket has the discounts of all
    monkeypatch.setattr(word_trigrams, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(quality, "FREQUENT", frequent)
    got = {r.doc_id: r.word_log_ppl for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = brute(rows, frequent, lambda u, v: v)
    assert got.keys() == want.keys()
    for d, value in want.items():
        assert got[d] is value is None or math.isclose(got[d], value, rel_tol=1e-9), d


def test_equal_rows_and_many_buckets_have_one_result(spark, monkeypatch):
    rng = random.Random(2)
    words = language(3, 60)
    rows = [(i, chain(rng, *words, 100), "x") for i in range(50)]
    rows += [(100, rows[0][1], "x"), (101, rows[0][1], "x"), (0, rows[0][1], "x")]
    monkeypatch.setattr(word_trigrams, "BUCKET_TRIGRAMS", 100)
    monkeypatch.setattr(word_trigrams, "LEAST_BUCKETS", 7)
    out = [quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 6)]
    one, six = ({(r.doc_id, r.n_words): r.word_log_ppl for r in x} for x in out)
    assert len(out[0]) == len(out[1]) == len(rows)
    assert all(math.isclose(one[k], six[k], rel_tol=1e-9) for k in one)
    assert len({round(one[k, 100], 9) for k in (0, 100, 101)}) == 1


def test_known_words_in_a_wrong_order_are_dropped(spark):
    rng = random.Random(4)
    words = language(5)
    rows = [(i, chain(rng, *words, 200), "x") for i in range(300)]
    mixed = [rows[i][1].split() for i in range(20)]
    for x in mixed:
        rng.shuffle(x)
    frame = spark.createDataFrame(rows + [(1000 + i, " ".join(x), "x") for i, x in enumerate(mixed)], SCHEMA)
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == {r[0] for r in rows}


def test_codes_come_back_and_ranges_of_a_hot_word_cover_all_contexts(monkeypatch):
    rng = np.random.default_rng(6)
    codes = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    assert (word_trigrams.unpack(word_trigrams.pack(codes), len(codes)) == codes).all()
    monkeypatch.setattr(word_trigrams, "BUCKET_TRIGRAMS", 1000)
    n = np.zeros(word_trigrams.CLASSES, np.int64)
    n[:50], n[7] = 400, 6000
    first = word_trigrams.bounds(n)
    assert (np.diff(first.astype(np.int64)) > 0).all()
    middle = (first >> np.uint64(word_trigrams.CLASS_BITS)).tolist()
    assert middle.count(7) > 3 and max(middle.count(i) for i in range(50) if i != 7) == 1


def test_documents_that_are_surely_kept_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    words = language(8)
    rows = [(i, chain(rng, *words, 100), "x") for i in range(300)] + [(1000 + i, "too short", "x") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for full in (False, True):
            if full:  # a filter that holds all rows
                ones = np.full(decontaminate.FILTER_BITS // 64, (1 << 64) - 1, np.uint64)
                monkeypatch.setattr(quality, "bloom", lambda _: ones)
            kept = quality.keep_good(frame)
            assert kept.columns == frame.columns
            assert {r.doc_id for r in kept.collect()} == set(range(300))
            moved = kept._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")
            assert len(moved) == 2 and "Union" in moved[0]
    finally:
        spark.conf.set(threshold, before)


def test_copies_are_left_to_deduplication(spark):
    rng = random.Random(9)
    words = language(10)
    rows = [(i, chain(rng, *words, 300), "x") for i in range(200)]
    rows += [(1000 + i, rows[0][1], "x") for i in range(3)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0].word_deviations < -quality.WIDTH and all(r.kept for r in out.values())


def test_replies_are_a_row_for_each_slice_of_a_bucket():
    rng = np.random.default_rng(13)
    sent = [np.sort(rng.integers(0, 1 << 30, 400).astype(np.uint64) << np.uint64(20) | rng.integers(0, 9, 400).astype(np.uint64)) for _ in range(5)]
    schema = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("contents", "texts", "logs"))])
    parts = [(i, len(c), word_trigrams.pack(c)) for i, c in enumerate(sent)]
    rows = [r for b in word_trigrams.scored(parts, np.full(word_trigrams.CLASSES, 1e-5), schema) for r in b.to_pylist()]
    assert [r["slice"] for r in rows] == list(range(5))
    sums = word_trigrams.Sums()
    for r in rows[:1]:
        sums.add(r["contents"], r["texts"], r["logs"])
    assert (sums.logs[:9] < 0).all() and not sums.logs[9:].any()


def test_packed_codes_of_one_slice_are_small():
    rng = np.random.default_rng(14)
    u, v, w = ((rng.zipf(1.2, 200_000) % (1 << 17)).astype(np.uint64) for _ in range(3))
    codes = np.sort(((v << np.uint64(18) | u) << np.uint64(18) | w) << np.uint64(10) | rng.integers(0, 500, len(u)).astype(np.uint64))
    steps = np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    whole = word_trigrams._codec.compress(np.ascontiguousarray(steps).tobytes(), asbytes=True)
    assert len(word_trigrams.pack(codes)) < 0.97 * len(whole)
