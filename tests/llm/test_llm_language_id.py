"""Language identification on texts held out, and awkward tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from haulmark.llm import language_id
from haulmark.llm.language_id import BUCKETS, ORDERS, Model, codewords, grams, identify

SOUNDS = {
    "aa": ["ka", "to", "mi", "ru", "sha"], "bb": ["xen", "vor", "jil", "qua", "zet"], "cc": ["blo", "gru", "thi", "wem"],
    "dd": ["ça", "ñu", "öl", "éi"], "ee": ["да", "не", "ру", "со"], "ff": ["日", "本", "語", "字"], "gg": ["pfa", "sch", "cht"],
}


def text(rng: random.Random, lang: str, words: int = 40) -> str:
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc"], sorted(SOUNDS)])
def test_languages_of_texts_held_out(spark, langs):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := langs[0] if i % 3 == 0 else rng.choice(langs)), lang) for i in range(400)]
    truth = {i: lang for i, _, lang in rows}
    # the labels of texts held out must not matter
    shown = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in rows]
    out = identify(spark.createDataFrame(shown, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == held_out(r.doc_id)
        assert r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 and r.runner_up in langs


def test_awkward_texts_and_labels(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang, "aa", "x", 1) for i, lang in enumerate(["aa", "bb"] * 40)]
    odd = [None, "", "  \n", "12 345 !?", "́", "x", text(rng, "aa", 200_000), text(rng, "aa", 60), text(rng, "aa", 60)]
    rows += [(1000 + i, t, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(None, text(rng, "bb"), "bb", None, None, None), (3, rows[3][1], "bb", None, None, None)]
    rows += [(2000, text(rng, "aa", 50) + " " + text(rng, "bb", 50), None, None, None, None)]
    schema = "doc_id long, text string, lang string, lang_pred string, bucket string, n int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = {}
    for r in identify(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i in range(5):
        assert out[1000 + i][0][2:4] == ("und", 0.0) and out[1000 + i][0].ambiguous
    assert out[1005][0].lang_pred in ("aa", "bb")
    assert [out[1006 + i][0].lang_pred for i in range(3)] == ["aa"] * 3
    assert out[None][0].lang_pred == "bb" and not out[None][0].held_out
    assert [r.lang_pred for r in out[3]] == ["bb", "bb"]
    assert out[2000][0].margin < out[1006][0].margin


def test_few_or_no_languages(spark):
    schema = "doc_id long, text string, lang string"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    unknown = identify(spark.createDataFrame([(1, "some words", None)], schema)).collect()
    assert unknown[0][2:4] == ("und", 0.0)
    one = identify(spark.createDataFrame([(1, "some words", "en"), (4, "other", None), (5, "", "en")], schema)).collect()
    assert {r.doc_id: r[2:4] for r in one} == {1: ("en", 1.0), 4: ("en", 1.0), 5: ("und", 0.0)}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 40, 150])
def test_codewords_are_far_apart(n):
    code = codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2
    assert set(np.unique(code)) == {-1.0, 1.0}
    assert (np.abs(code.sum(0)) < n).all()
    assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n < 4 else code.shape[1] / 4)


def test_one_wrong_bit_is_corrected():
    code = codewords(4)
    model = Model(list("abcd"), code, np.zeros((7, BUCKETS)), np.ones(7), np.ones((4, 7)))
    for lang, flipped in ((i, j) for i in range(4) for j in range(7)):
        bits = code[lang].copy()
        bits[flipped] *= -1
        assert model.losses(bits[None, :])[0].argmin() == lang


def test_grams_do_not_cross_texts_or_windows(monkeypatch):
    def counted(texts):
        out = np.zeros((len(texts), BUCKETS), np.int64)
        for bucket, some, start in grams(pa.array(texts)):
            for i, b, e in zip(some, start, np.append(start[1:], len(bucket)), strict=True):
                out[i] += np.bincount(bucket[b:e], minlength=BUCKETS)
        return out

    texts = [" ab ", "", " añb cd ", "x", " " + "hello there " * 30]
    want = np.concatenate([counted([t]) for t in texts])
    assert (counted(texts) == want).all()
    assert [int(r.sum()) for r in want] == [sum(max(len(t.encode()) - k + 1, 0) for k in ORDERS) for t in texts]
    monkeypatch.setattr(language_id, "_WINDOW", 5)
    assert (counted(texts) == want).all()


def test_counts_and_predictions_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sorted(identify(df.repartition(n)).collect()) for n in (1, 7))
    assert a == b
