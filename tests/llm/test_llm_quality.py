"""The perplexity of op9: every word counts as itself, every language has its own model and band."""

from __future__ import annotations

import math
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from haulmark.llm import common, quality  # noqa: E402
from haulmark.llm.common import AS_WRITTEN, Words  # noqa: E402
from haulmark.llm.word_units import Places  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def vocabulary(seed: int, size: int = 300) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 11))) for _ in range(size)]


def text(rng: random.Random, words: list[str], n: int = 200) -> str:
    return " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))


def brute(rows: list[tuple]) -> dict[int, float]:
    """Log perplexities from word lists and counters."""
    read = {}
    for d, content, lang in rows:
        words = Words(pa.array([content or ""]), AS_WRITTEN)
        read[d] = lang, (content or "").split(), quality.units(words).tolist()
    counts, three, units, own = defaultdict(Counter), defaultdict(Counter), defaultdict(dict), {}
    for lang, words, unit in read.values():
        counts[lang].update(words)
        units[lang].update(zip(words, unit, strict=True))
        three[lang].update((a << 14) | (b << 7) | c for a, b, c in zip(unit, unit[1:], unit[2:], strict=False))
    for lang in counts:
        own[lang] = quality.KneserNey(*(np.array(x, np.int64) for x in zip(*sorted(three[lang].items()), strict=True)))
    out = {}
    for d, (lang, words, unit) in read.items():
        if len(words) < 3:
            out[d] = None
            continue
        codes = np.array([(a << 14) | (b << 7) | c for a, b, c in zip(unit, unit[1:], unit[2:], strict=False)])
        total, mine = 0.0, Counter(words)
        for w in words:
            peers = [n for x, n in counts[lang].items() if units[lang][x] == units[lang][w]]
            once, twice = peers.count(1), peers.count(2)
            off = once / (once + 2 * twice) if once and twice else 0.75
            left = max(counts[lang][w] - mine[w] - off, 0)
            total += math.log((left + off * len(peers) / (len(peers) + 1)) / sum(peers))
        out[d] = -own[lang].log_probability(codes).mean() - total / len(words)
    return out


def test_log_perplexity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = {lang: vocabulary(i) for i, lang in enumerate(["x", "y", None])}
    rows = [(i, text(rng, words[lang := rng.choice(["x", "y", None])], rng.randrange(1, 150)), lang) for i in range(120)]
    rows += [(200, None, "x"), (201, "", None), (202, "One two", "z"), (203, "Alone in. its lang*", "z")]
    want = brute(rows)
    for frequent in (0, 40):
        monkeypatch.setattr(quality, "FREQUENT", frequent)
        got = {r.doc_id: r.log_ppl for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
        assert got.keys() == want.keys()
        for d, value in want.items():
            assert got[d] is value is None or math.isclose(got[d], value, rel_tol=1e-9), d


def test_words_that_no_text_holds_and_other_languages_are_rejected(spark):
    rng = random.Random(2)
    words = vocabulary(10), vocabulary(11)
    rows = [(i, text(rng, words[i % 2]), "xy"[i % 2]) for i in range(400)]
    rows += [(1000 + i, " ".join(vocabulary(100 + i, 200)), "x") for i in range(10)]
    rows += [(2000 + i, text(rng, words[1]), "x") for i in range(10)]
    out = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)


def test_each_of_many_languages_has_its_own_band(spark):
    rng = random.Random(3)
    rows, foreign = [], []
    for i in range(24):
        words = vocabulary(20 + i)
        rows += [(1000 * i + j, text(rng, words), f"l{i}") for j in range(60 if i < 20 else 30)]
        foreign.append((1000 * i + 900, text(rng, vocabulary(20 + (i + 1) % 24)), f"l{i}"))
    frame = spark.createDataFrame(rows + foreign, SCHEMA)
    out = quality.judge(frame).collect()
    assert {r.doc_id for r in out if not r.kept} == {d for d, _, _ in foreign}
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == {d for d, _, _ in rows}


def test_a_table_of_all_codes_equals_the_model():
    rng = np.random.default_rng(11)
    codes, n = np.unique(rng.integers(0, 1 << 3 * quality.BITS, 5000) // 97 * 97, return_counts=True)
    model = quality.KneserNey(codes, n)
    wanted = np.concatenate((codes[::7], rng.integers(0, 1 << 3 * quality.BITS, 2000)))
    assert (model.log_table()[wanted] == model.log_probability(wanted)).all()


def test_words_that_occur_once_are_one_row_of_their_unit(spark):
    rows = [(i, f"common words lone{'abcdefgh'[i]}", 5) for i in range(8)]
    got = quality.count(spark.createDataFrame(rows, "doc_id long, text string, group long").coalesce(1)).collect()
    words = [r for r in got if r.unit != quality.TRIGRAM]
    assert sorted((r.n, r.words) for r in words) in ([(1, 8), (8, 1), (8, 1)], [(1, 1)] * 8 + [(8, 1)] * 2)
    once = [(r.group, r.unit) for r in words if r.n == 1]
    assert len(once) == len(set(once)) and sum(r.n * r.words for r in words) == 24
    assert sum(r.n for r in got if r.unit == quality.TRIGRAM) == 8


def test_hashes_are_found_by_their_leading_bits():
    rng = np.random.default_rng(12)
    for size in (0, 1, 1000):
        table = np.unique(rng.integers(0, 1 << 64, size, np.uint64, endpoint=False) >> np.uint64(rng.integers(0, 3)))
        keys = np.concatenate((table, rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
        at, known = Places(table).get(keys)
        assert (known == np.isin(keys, table)).all() and (table[at[known]] == keys[known]).all()


def test_shuffle_files_leave_the_disk_once_a_table_is_written(spark):
    def files() -> int:
        held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(held.apply(i).getName().startswith("shuffle_") for i in range(held.size()))

    frame, before = spark.range(10_000).groupBy(F.col("id") % 100).count(), files()
    lean = common.keep_lean(frame, "lean")
    assert files() == before
    kept = common.keep(frame, "kept")
    assert files() > before
    assert lean.count() == kept.count() == 100
