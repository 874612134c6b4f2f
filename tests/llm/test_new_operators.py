"""Token files, spelling variants and hard negatives against plain versions."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritrail.llm import negatives, spelling, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPLIT = Tokenizer.from_file(TOKENIZER).pre_tokenizer.pre_tokenize_str


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,-_0123abcXYZ\xa0é²½’…"), st.characters(codec="utf-8")), max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_tokenizer(texts):
    texts += ["it's  we'll ' s", "a<|endoftext|>b", "x\x1cy\x85z"]
    want = [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(TOKENIZER)(texts)] == want


def test_pieces_after_a_space_are_encoded_together():
    words = ["the", "2024", "...", "'", "$$", "it", "12", "%", "é", "²", "_"]
    pieces = [f" {a}" for a in words] + ["x", " ", "\n", "  ", " \n", "'s", "7"]
    texts = ["".join(pieces), "  ".join(pieces), " ' s' 12 34 ... ...", "one", ""]
    own, plain, asked = token_files.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), []
    each = own.each
    own.each = lambda x: asked.extend(x) or each(x)
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert not [x for x in asked if x[:1] == " " and x.strip()]


@given(st.lists(st.text(alphabet=" \n\t\xa0'stmdrevlX7.é×÷²½€’", max_size=25), max_size=8))
@settings(max_examples=1000, deadline=None)
def test_cuts_are_the_tokenizer_s_own(texts):
    parts = [x.encode() for x in texts]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    want = [int(at) + len(x[:a].encode()) for x, at in zip(texts, bounds, strict=False) for _, (a, _) in SPLIT(x)]
    assert token_files.cuts(b"".join(parts), bounds).tolist() == [*want, bounds[-1]]


def test_every_character_is_cut_as_by_the_tokenizer():
    for x in map(chr, range(0x2100)):
        for text in [f"a{x}1{x}{x}b.{x}  {x}"] * (not token_files.is_odd(x)):
            want = [len(text[:a].encode()) for _, (a, _) in SPLIT(text)]
            assert token_files.cuts(text.encode(), np.array([0, len(text.encode())])).tolist()[:-1] == want, x


def test_a_piece_is_asked_for_once_in_a_stretch():
    own, plain, asked = token_files.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), []
    of = own.of
    own.of = lambda keys: asked.extend(keys) or of(keys)
    texts = [f"{k % 7} words, and it's {k % 3} more.\n" * 20 for k in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(asked) == len(set(asked)) < 25


def test_cuts_outlive_a_change_of_cache(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_CACHE", 5)
    own, plain = token_files.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for texts in (["one two three four five six", ""], ["seven one two eight"], [], [""], ["a<|b"], ["two nine"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert b" two" in own.known and b" three" in own.older and b" three" not in own.known


@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 4097, 20_000])
def test_codes_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype("<u4")
    held = token_files.TokenFile(token_files.encoded([5, None], np.array([0, n // 3, n]), ids))
    assert held.doc_ids == [5, None] and len(held) == n and len(held.widths) <= token_files.MAX_LEVELS
    assert (held.take(np.arange(n)[::-1]) == ids[::-1]).all() and (held.document(1) == ids[n // 3 :]).all()
    for start in (0, n // 7, n // 2):
        assert (held.ids(start, n - n // 9) == ids[start : n - n // 9]).all()
    if n:
        assert held.at(n - 1) == ids[-1]
    with pytest.raises(IndexError):
        held.at(n)
    with pytest.raises(IndexError):
        held.ids(0, n + 1)


def test_widths_are_the_smallest():
    ids = np.random.default_rng(1).zipf(1.3, 4000).clip(0, 50_000).astype("<u4")

    def size(widths):
        bits, at = 0, 0
        for w in widths:
            left = int((ids >> at > 0).sum()) if at else len(ids)
            bits, at = bits + left * (w + (at + w < 16)), at + w
        return bits

    tried = [(a, b, c) for a in token_files.WIDTHS for b in token_files.WIDTHS for c in (0, *token_files.WIDTHS) if a + b + c >= 16]
    best = token_files.best_widths(ids)
    assert sum(best) >= 16 and size(best) == min(size([w for w in x if w]) for x in tried)


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    files = token_files.write_token_files(odd, str(tmp_path), ids_a_file=50)
    got = [tuple(x) for x in token_files.read_token_files(files).orderBy("start").collect()]
    rows = [(x.doc_id, [*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 2]) for x in odd.collect()]
    assert [x[0] for x in got] == sorted((x[0] for x in rows), key=lambda d: -1 if d is None else d)
    assert sorted(((d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for d, i in rows), key=str) == sorted(((d, n, c) for d, _, n, c in got), key=str)
    assert [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    names = sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith("."))
    assert len(names) == files.count() > 4 and not [x for x in names if x.endswith(".part")]
    first = token_files.TokenFile((tmp_path / names[0]).read_bytes())
    assert first.at(len(first) - 1) == 2
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0


def variants_plainly(rows, drop=True):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if drop and h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    cut, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[w[:k] + "*" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        if top and words[top] >= 5 * n:
            form[w] = top
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = ["spelling", "variant", "grouping", "größenwahn", "abcdefgh", "aabbaabb", "straße", "filter"]
    texts = []
    for k in range(900):
        words = []
        for _ in range(30):
            w = rng.choice(base) if rng.random() < 0.9 else base[0]
            while rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeßz") + w[at:], w[:at] + rng.choice("aeßzX") + w[at + 1 :]])
            words.append(w if rng.random() < 0.8 else w.upper())
        texts.append((k if k % 50 else None, rng.choice([" ", "-", "\n", "7"]).join(words)))
    texts += [(901, None), (902, ""), (903, "qwerty " * 5 + "z" * 3000), (903, "qwerty " * 5 + "z" * 3000), (904, " ".join(["z" * 2999] * 5 + ["z" * 3000] * 4))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "near", "root")}).repartition(3)
    want = variants_plainly(texts)
    assert len(want) > 200 and any(x[1] and x[1] != x[2] for x in want)
    assert {tuple(x) for x in spelling.variants(spelling.words(df)).select(COLUMNS).collect()} == want
    monkeypatch.setattr(spelling, "MAX_WORDS", 60)  # several filters
    assert {tuple(x) for x in spelling.variants(spelling.words(df)).select(COLUMNS).collect()} == want


def test_variants_of_odd_rows(spark, odd, none):
    got = {tuple(x) for x in spelling.variants(spelling.words(odd)).select(COLUMNS).collect()}
    assert got == variants_plainly([(x.doc_id, x.text) for x in odd.collect()])
    assert spelling.variants(spelling.words(none)).count() == 0


def negatives_in_sql(spark, rows):
    con = duckdb.connect()
    con.register("embeddings", rows.toArrow())
    return sorted(con.sql(negatives.OP13_SQL).fetchall())


def mined(rows):
    rows = rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return sorted(tuple(x) for x in negatives.hard_negatives(rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("tile,leaf,block", [(4096, 64, 2048), (60, 8, 5)])
def test_negatives_by_brute_force(spark, monkeypatch, tile, leaf, block):
    for name, value in (("TILE", tile), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = [(k, (centres[k % 12] + 0.3 * rng.normal(size=6)).tolist(), int(k * 7 % 4)) for k in range(900)]
    vectors += [(900 + k, [0.5] * 6, k % 2) for k in range(300)]  # copies: ties
    vectors += [(1300, [float("nan")] * 6, 1), (1350, [float("inf")] * 6, 1), (1400, None, 1), (1450, [1.0] * 6, None), (1500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (1550, [0.0] * 6, 3), (None, [1.0] * 6, 1)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("tile", "cell", "block", "id", "anchor")}).repartition(3)
    want = negatives_in_sql(spark, rows.select("vec_id", "embedding", "label"))
    assert len(want) > 200 and mined(rows) == want


def test_negatives_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert mined(spark.createDataFrame([], kind)) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1), (50, [1.0], 1), (51, [], 1), (52, [1.0, 3.0], 2)], kind)) == []
    # products beyond what a double holds, and shorter vectors
    big = [(50, [4e6, 1.0], 1), (51, [3e6, 7.0, 5.0], 1), (52, [2e6, 1.0], 2), (53, [2e6, 3.0], 2), (54, [2e6 + 1 / 256], 2), (55, [-2e6], 2)]
    product = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b, strict=False))
    scores = sorted(((-product(big[0][1], x[1]), x[0]) for x in big[2:5]))
    assert mined(spark.createDataFrame(big, kind)) == [(50, 51, k + 1, i, product(big[0][1], big[1][1]), -s) for k, (s, i) in enumerate(scores)]
