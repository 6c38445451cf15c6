"""The operators against brute force on texts with every awkward case."""

from __future__ import annotations

import math
import zlib

import llm_brute as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from haulmark.llm import range_coder  # noqa: E402
from haulmark.llm.decontaminate import decontaminate, drop_contaminated  # noqa: E402
from haulmark.llm.encoding import Encoder  # noqa: E402
from haulmark.llm.graphs import components  # noqa: E402
from haulmark.llm.language_model import score  # noqa: E402
from haulmark.llm.near_dedup import across, keep_first, near_duplicates  # noqa: E402
from haulmark.llm.packing import Bins, first_fit, pack  # noqa: E402
from haulmark.llm.quality import judge, keep_good  # noqa: E402
from haulmark.llm.secrets import base_spans, redact, scan, spans_of  # noqa: E402
from haulmark.llm.substring_dedup import remove_repeats  # noqa: E402
from haulmark.llm.token_files import round_trip  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# --- 1 packing ---------------------------------------------------------------------------


def test_packing_places_every_id_once(docs, doc_rows, tokenizer):
    got = pack(docs, PATH, length=128, group_docs=20).collect()
    want = []
    for d, text in pairs(doc_rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(d, b, len(ids[b : b + 128]), brute.crc(ids[b : b + 128]), len(ids)) for b in range(0, len(ids), 128)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    fill: dict[int, list] = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 128
    used = sum(s for spans in fill.values() for _, s in spans)
    assert used >= 0.95 * 128 * len(fill)


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 101, rng.integers(1, 200)).tolist(), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= s
        assert list(zip(*first_fit(sizes, 100), strict=True)) == want
    assert Bins(1, 5).place(5) == (0, 0)


# --- 3 token files -----------------------------------------------------------------------


def test_token_files_give_back_every_id(docs, doc_rows, tokenizer):
    got = round_trip(docs, PATH).collect()
    want = [
        (d, len(ids), brute.crc(ids))
        for d, text in pairs(doc_rows)
        for ids in [[*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]]
    ]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    order = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]


def test_documents_may_cross_segments(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.fs as pafs

    from haulmark.llm import token_files as tf

    monkeypatch.setattr(tf, "SEGMENT_IDS", 1000)
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 999, 1, 2500, 0, 1000, 700)]
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "x.tok")
    with fs.open_output_stream(path) as out:
        writer = tf.FileWriter(out)
        for i, ids in enumerate(docs):
            writer.add(pa.array([None if i == 1 else i], pa.int64()), ids, np.array([len(ids)]))
        assert writer.close() == len(docs)
    with fs.open_input_file(path) as file:
        ids, sizes = tf.read_table(file)
        assert ids.to_pylist() == [None if i == 1 else i for i in range(len(docs))]
        assert tf.checksums(tf.read_segments(file), np.cumsum(sizes)) == [brute.crc(d) for d in docs]
    data = bytearray((tmp_path / "x.tok").read_bytes())
    data[-60] ^= 1
    (tmp_path / "x.tok").write_bytes(data)
    with fs.open_input_file(path) as file, pytest.raises(tf.BadFile):
        tf.read_table(file)


def test_new_chunks_reach_the_library_some_in_one_text(tokenizer):
    import random

    import pyarrow as pa

    from haulmark.llm.encoding import JOINED

    class Counting:
        texts = 0

        def encode_batch_fast(self, given, **options):
            self.texts += len(given)
            return tokenizer.encode_batch_fast(given, **options)

        def __getattr__(self, name):
            return getattr(tokenizer, name)

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeéüß") for _ in range(rng.randrange(2, 12))) for _ in range(2000)})
    own = Encoder(PATH)
    own.tokenizer = Counting()
    ids, upto = own.encode(pa.array([" ".join(words)]))
    assert ids.tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert own.tokenizer.texts <= len(words) / JOINED + 2
    odd = [*"abcZ09.,;'\"-!_\n\t\r\x0b\x00\x1c\x7f\u0085\u00a0\u1680\u180e\u2003\u2028\u3000\u200b\u0301¼Ⅷ«–日", *" " * 12, "'s"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    ids, upto = Encoder(PATH).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[upto[i] : upto[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_that_came_again_stay_known(tokenizer):
    import pyarrow as pa

    class Counting:
        given = ()

        def encode_batch_fast(self, given, **options):
            self.given += tuple(given)
            return tokenizer.encode_batch_fast(given, **options)

        def __getattr__(self, name):
            return getattr(tokenizer, name)

    own = Encoder(PATH, chunks=200)
    own.tokenizer = counting = Counting()
    often, odd = "the cat's new-found house, naïve 日本 words 12", "some\u2003gap \u2003here"
    most = 0
    for turn in range(1, 7):
        counting.given = ()
        ids, _ = own.encode(pa.array([often, odd]))
        assert ids.tolist() == [*own.whole(often).tolist(), *own.whole(odd).tolist()]
        assert bool(counting.given) == (turn == 1)
        new = " ".join("".join(chr(97 + int(c)) for c in str(10_000 * turn + i)) for i in range(150))
        assert own.encode(pa.array([new]))[0].tolist() == tokenizer.encode(new, add_special_tokens=False).ids
        most = max(most, own.known.count)
    assert 200 < most < 400


def test_units_follow_the_key_and_the_bound():
    import pyarrow as pa

    from haulmark.llm.packing import units

    keys = [1, 1, 2, 2, 2, 2, 3]
    batches = [pa.record_batch({"k": keys[i : i + 2], "v": list(range(i, min(i + 2, 7)))}) for i in range(0, 7, 2)]
    assert [u.column("v").to_pylist() for u in units(iter(batches), "k")] == [[0, 1], [2, 3, 4, 5], [6]]
    assert [u.num_rows for u in units(iter(batches), "k", most=2)] == [2, 2, 2, 1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=400), st.sampled_from([1, 7, 64, 2048]))
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    assert (range_coder.decode(range_coder.encode(ids, block)) == ids).all()


def test_range_coder_learns_and_notices_damage():
    ids = np.tile(np.array([5, 900, 40000, 7], np.uint32), 3000)
    blocks = range_coder.encode(ids)
    assert (range_coder.decode(blocks) == ids).all()
    assert sum(len(b[2]) for b in blocks) < len(ids) / 4
    size, crc, code = blocks[0]
    with pytest.raises(range_coder.BadBlock):
        range_coder.decode([(size, crc, code[:9] + bytes([code[9] ^ 1]) + code[10:]), *blocks[1:]])
    with pytest.raises(ValueError):
        range_coder.encode(np.array([65536], np.uint32))


def test_range_coder_blocks_learn_frequencies_and_contexts_together():
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 20_001)
    share /= share.sum()
    ids = rng.permutation(50_000)[rng.choice(20_000, 300_000, p=share)].astype(np.uint32)
    blocks = range_coder.encode(ids)
    assert (range_coder.decode(blocks) == ids).all()
    entropy = -(share * np.log2(share)).sum()
    assert sum(len(b[2]) for b in blocks) * 8 < (entropy + 1) * len(ids)
    # what a block alone is too short to learn: pairs that come once in each
    pairs = rng.integers(0, 50_000, 1024).astype(np.uint32)
    ids = np.concatenate([p for _ in range(100) for p in np.stack((pairs, pairs ^ 1), axis=1)[rng.permutation(1024)]])
    blocks = range_coder.encode(ids)
    assert (range_coder.decode(blocks) == ids).all()
    assert sum(len(b[2]) for b in blocks) * 8 < 8 * len(ids)


def test_range_coder_carries_and_notices_damage_anywhere():
    rng = np.random.default_rng(6)
    ids = np.where(rng.random(20_000) < 0.7, 65535, rng.integers(0, 65536, 20_000)).astype(np.uint32)
    blocks = range_coder.encode(ids, 512)
    assert (range_coder.decode(blocks) == ids).all()
    for at in range(0, len(blocks), 7):
        size, crc, code = blocks[at]
        for bad in (code[:-12], code[:3] + bytes([code[3] ^ 128]) + code[4:], b"\xff" * len(code)):
            with pytest.raises(range_coder.BadBlock):
                range_coder.decode([*blocks[:at], (size, crc, bad), *blocks[at + 1 :]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b\x1c 　abé'.!1s", max_size=30), max_size=4))
def test_chunked_encoding_equals_the_library(texts):
    import pyarrow as pa

    encoder = CHUNKED.setdefault("e", Encoder(PATH, chunks=200))
    ids, upto = encoder.encode(pa.array(texts, pa.string()), last=2)
    for i, text in enumerate(texts):
        assert ids[upto[i] : upto[i + 1]].tolist() == [*encoder.whole(text).tolist(), 2]


CHUNKED: dict = {}
ADDED = "<|endoftext|>"
PIECES = [*" \n\t　abé'.!1s", " the", " quick", ADDED, "<|", "|>", "endoftext", " " + ADDED]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_added_tokens_are_found_as_the_library_does(texts):
    import pyarrow as pa

    encoder = CHUNKED.setdefault("e", Encoder(PATH, chunks=200))
    ids, upto = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[upto[i] : upto[i + 1]].tolist() == encoder.whole(text).tolist()


def test_packing_and_files_with_added_tokens(spark, tokenizer):
    texts = [f"see {ADDED} here", ADDED, ADDED * 2, f"{ADDED} at the beginning", f"at the end {ADDED}", f"in{ADDED}side", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in ids[0]
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in pack(df, PATH, length=64).collect()}
    assert packed == {i: (len(x) + 1, brute.crc([*x, 0])) for i, x in enumerate(ids)}
    filed = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in round_trip(df, PATH).collect()}
    assert filed == {i: (len(x) + 1, brute.crc([*x, 2])) for i, x in enumerate(ids)}


# --- 4 near duplicates -------------------------------------------------------------------


def test_near_duplicates(docs, doc_rows, same):
    same(near_duplicates(docs).collect(), brute.near_duplicates(pairs(doc_rows)))


def test_near_duplicate_chains_and_hot_groups(spark, same):
    import random

    rng = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain: each text differs a little from the one before
        rows.append((1000 - i, " ".join(words)))
        words[(2 * i) % 120] = f"c{rng.randrange(10**6)}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_duplicates(frame).collect(), brute.near_duplicates(rows))


def test_members_of_different_components_meet_in_blocks(spark, monkeypatch):
    import haulmark.llm.near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 8)
    sketch, bands = bytes(nd.SKETCH_BITS // 8), list(range(nd.BANDS))
    rows = []
    for i in range(60):  # pairs i, i + 30 are links, all lie in one band, the first half is one component
        shingles = np.arange(100 * (i % 30), 100 * (i % 30) + 50, dtype=np.uint64).tobytes()
        rows.append((1, 0, i, 0 if i < 30 else i, 60, 50, sketch, bands, shingles))
    cols = "band long, i int, doc_id long, component long, size long, n long, sketch binary, bands array<bigint>, shingles binary"
    got = {tuple(r) for r in across(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(i, i + 30) for i in range(30)}
    other = [(*r[:1], 1, *r[2:]) for r in rows]  # not the first band that they share
    assert across(spark.createDataFrame(other, cols)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (200, 300), (300, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(98, 98), (99, 98), (100, 98), (200, 200), (300, 200)}


def test_one_of_each_group_stays(docs, doc_rows):
    kept = {r.doc_id for r in keep_first(docs).collect()}
    assert kept == {d for d, _, c, k in brute.near_duplicates(pairs(doc_rows)) if k}
    assert keep_first(docs).columns == docs.columns


# --- 5 decontamination -------------------------------------------------------------------


def test_decontamination(docs, doc_rows, benchmark, same):
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    want = brute.leaks(pairs(doc_rows), items)
    same(decontaminate(docs, benchmark).collect(), want)
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == sum(not r[5] for r in want)


def test_decontamination_of_shared_and_overlapping_spans(spark, same):
    import random

    rng = random.Random(11)
    source = [f"k{rng.randrange(6)}" for _ in range(400)]  # few words, so that runs repeat
    items = [(i, " ".join(source[b : b + n])) for i, (b, n) in enumerate([(0, 40), (20, 11), (100, 10), (5, 3), (7, 1)])]
    rows = [(i, " ".join(source[rng.randrange(300) :][: rng.randrange(40)])) for i in range(60)]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate(frame, bench).collect(), brute.leaks(rows, items))


# --- 6 secrets ---------------------------------------------------------------------------


def test_base_spans(doc_rows):
    texts = [t or "" for _, t in pairs(doc_rows)]
    for text, (base, _) in zip(texts, spans_of(texts), strict=True):
        assert [(k, s, e) for k, s, e, _ in base] == brute.base_spans(text)


def test_secrets(docs, doc_rows):
    import hashlib

    got = sorted(map(tuple, scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=repr)
    want = []
    for d, text in pairs(doc_rows):
        spans = brute.base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
        want.append((d, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_copied_secrets_are_told_from_live_ones(spark):
    key = "password = Zx81Qw72Lm03Kd94"
    rows = [(i, f"text {key} here", f"owner{i}", "en") for i in range(3)]
    rows += [(9, "token = aB3dE5fG7hJ9kL1m and " + "Qw3rTy7uIoP1aSdF9gHjK2lZ" * 2, "owner9", "en"), (10, "none", None, None)]
    out = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert [(out[i].n_live, out[i].n_copied) for i in range(3)] == [(0, 1)] * 3
    assert out[9].n_live == 2 and out[9].n_copied == 0
    assert out[9].spans.split(",")[1].startswith("opaque:")
    assert (out[10].spans, out[10].n_live) == ("", 0)


def test_secrets_are_weighed_by_documents_and_repositories(spark):
    import random

    rng = random.Random(8)

    def prose(n):
        return " ".join(f"w{rng.randrange(400)}" for _ in range(n))

    many, langs, live, two = (f"Qw3rTy7uIoP1aSdF9gHjK2l{c}" for c in "ABCD")
    rows = [(i, f"{prose(40)} {many}", "a", "en") for i in range(30)]
    rows += [(100 + i, f"{prose(40)} {langs}", "a", f"l{i}") for i in range(4)]
    text = f"{prose(200)} {live} {prose(9)}"
    rows += [(200, text, "a", "en"), (201, text, "b", "en"), (202, text + " edited", "c", "de")]
    rows += [(300 + i, f"{prose(40)} {two}", "a", "en") for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r.doc_id: (r.n_live, r.n_copied, r.spans.split(":")[0]) for r in scan(frame).collect()}
    assert all(out[i] == (0, 1, "") for i in (*range(30), *range(100, 104)))
    assert all(out[i] == (1, 0, "opaque") for i in (200, 201, 202, 300, 301))


def test_redaction(docs, doc_rows):
    got = redact(docs)
    assert got.schema == docs.schema
    rows = got.collect()
    assert len(rows) == len(doc_rows)
    assert all(not brute.base_spans(r.text) for r in rows)
    clean = {(d, t) for d, t in pairs(doc_rows) if not brute.base_spans(t) and "ghp_" not in (t or "")}
    assert clean <= {(r.doc_id, r.text) for r in rows}
    assert all(r.n_chars == len(r.text) for r in rows if r.text)


# --- 8 repeated passages -----------------------------------------------------------------


def test_repeated_passages(docs, doc_rows, same):
    same(remove_repeats(docs).collect(), brute.repeats(pairs(doc_rows)))


def test_repeats_inside_and_across_texts(spark, same, monkeypatch):
    import random

    import haulmark.llm.substring_dedup as sd

    monkeypatch.setattr(sd, "PART_ROWS", 3)  # split subtrees
    rng = random.Random(2)
    block = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(40):
        b = rng.randrange(20)
        text = [*(f"f{rng.randrange(9)}" for _ in range(rng.randrange(8))), *block[b : b + rng.randrange(40, 70)]]
        rows.append((rng.randrange(30), " ".join(text * rng.randrange(1, 3))))
    rows += [(31, "z " * 500), (32, "z " * 130), (33, "z " * 49)]
    same(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute.repeats(rows))


def test_rows_of_near_copies_grow_in_proportion(spark, monkeypatch):
    import random

    import haulmark.llm.substring_dedup as sd

    monkeypatch.setattr(sd, "PART_ROWS", 64)
    made, grow = [], sd.grow

    def counted(dealt):
        out = grow(dealt)
        made.append((dealt.count(), out.count()))
        return out

    monkeypatch.setattr(sd, "grow", counted)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    for n in (300, 600, 1200):
        rows = []
        for i in range(n):
            text = list(base)
            text[rng.randrange(200)] = f"own{i}"
            rows.append((i, " ".join(text)))
        remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).count()
    for (sent, left), (sent2, left2) in zip(made, made[1:], strict=False):
        assert sent2 < 2.5 * sent and left2 < 2.5 * left


# --- 9 quality ---------------------------------------------------------------------------


def test_quality_counts(docs, doc_rows):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = judge(docs).collect()
    got = sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
    assert got == sorted((brute.quality(*p) for p in pairs(doc_rows)), key=repr)
    assert all(not r.kept for r in rows if r.base_failed)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == sorted(r.doc_id or 0 for r in rows if r.kept)


def test_perplexity_bands_reject_on_both_sides(spark):
    import random

    rng = random.Random(4)
    common = ["the", "of", "and", "to", "a"]

    def clean(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else f"{rng.choice('bcdf')}{'aeiou'[rng.randrange(5)] * 2}nting" for _ in range(n))

    rows = [(i, clean(rng.randrange(60, 300)), "en") for i in range(300)]
    rows += [(1000, " ".join(w + "***" for w in clean(200).split()), "en"), (1001, clean(200).upper() + "!!", "en")]
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(300))
    assert not out[1000].kept and not out[1001].kept


def test_kneser_ney_sums_to_one():
    from haulmark.llm.quality import UNITS, KneserNey

    rng = np.random.default_rng(3)
    codes, counts = np.unique(rng.zipf(1.2, 50_000) * 7919 % UNITS**3, return_counts=True)
    model = KneserNey(codes, counts)
    for context in (*codes[:3] >> 7, 5):
        total = np.exp(model.log_probability((int(context) << 7) + np.arange(UNITS))).sum()
        assert abs(total - 1) < 1e-9


# --- 10 language model -------------------------------------------------------------------


def test_unigram_scores(docs, doc_rows):
    rows = sorted(score(docs).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(brute.unigram(pairs(doc_rows)), key=lambda r: (repr(r[0]), r[2], r[5]))
    assert len(rows) == len(want)
    for got, (d, held_out, n, known, total, base) in zip(rows, want, strict=True):
        assert (got.doc_id, got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (d, held_out, n, known, total)
        assert math.isclose(got.base_score, base, rel_tol=1e-9)
        assert got.score < 0 or n == 1


def test_model_beats_unigrams_on_texts_held_out(spark):
    import random

    rng = random.Random(6)
    vocab = {"x": [f"{w}el" for w in "abcdefgh"], "y": [f"{w}ot" for w in "abcdefgh"]}
    rows = [(i, " ".join(rng.choice(vocab["xy"[i % 2]]) for _ in range(80)), "q") for i in range(400)]
    out = score(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    held = [r for r in out if r.held_out]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 1 for i in range(400))
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


# --- all ---------------------------------------------------------------------------------


def test_empty_tables(no_docs, benchmark):
    made = [
        pack(no_docs, PATH), round_trip(no_docs, PATH), near_duplicates(no_docs), keep_first(no_docs),
        decontaminate(no_docs, benchmark), decontaminate(no_docs, benchmark.limit(0)), scan(no_docs), redact(no_docs),
        remove_repeats(no_docs), judge(no_docs), keep_good(no_docs), score(no_docs),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_an_empty_benchmark_finds_nothing(docs, doc_rows, benchmark):
    rows = decontaminate(docs, benchmark.limit(0)).collect()
    assert len(rows) == len(doc_rows) and not any(r.contaminated for r in rows)
