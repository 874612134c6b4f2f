"""Operators that SQL can't express, against plain versions of the same definitions; and ties, odd rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ALNUM, SPACED, low
from veritrail.llm import fingerprints, language, licenses, lm_score, neardup, secrets, toxicity

M = (1 << 64) - 1


def saved(spark, tmp_path, rows, schema="doc_id long, text string", name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_op5_base_spans(spark, tmp_path):
    rng = random.Random(30)
    bits = ["password: hunter2hunter2", 'API_KEY = "abcDEF12/+=-_."', "apikey='short'", "Token=abcdefgh", "secret :  zzzzzzzz.zz", "AKIAABCDEFGHIJKL", "AKIA123", "xAKIA" + "Z" * 30, "0123456789abcdef" * 2, "deadbeef" * 5 + "G", "é", "ß ", " ", "\n", ",", "passwd:=aaaaaaaaa", "PASSWORD:'q1w2e3r4t5'"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "日本 "]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(120, None), (121, "")]
    got = {x["doc_id"]: x for x in secrets.op5_secret_scan(spark, saved(spark, tmp_path, rows)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text in rows:
        found = [("assign", m.span()) for m in assign.finditer(text or "") if len(m[2]) >= 8]
        found += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        found += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        order = sorted(found, key=lambda x: (x[1][0], ["assign", "access", "hex"].index(x[0])))
        written = ",".join(f"{k}:{a}:{b}" for k, (a, b) in order)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in found) for k in ("assign", "access", "hex")]
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i]["spans"].split(","))


def test_op2_labels_and_places(spark):
    rng = random.Random(31)
    notices = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in licenses.TEMPLATES]
    filler = ["software", "license", "mit", "apache", "general", "public", "the", "x1", "é", "copy", "permission"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            own = list(rng.choice(notices)[1])
            for _ in range(rng.choice((0, 0, 1, len(own) // 5, len(own) // 2))):
                own[rng.randrange(len(own))] = rng.choice(filler)
            words += [rng.choice(filler) for _ in range(rng.randint(0, 6))] + own[rng.choice((0, 0, 3)) :]
        rows.append((i, rng.choice((" ", ", ")).join(words).upper() if i % 5 else " ".join(words)))
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = re.findall(ALNUM, low(text))
        base = [(p, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        labels, score = {x for _, x in base}, 0.5 if base else 0.0
        for label, own, keys in notices:
            for p in range(len(w)):
                here = w[p : p + len(own)]
                held = sum(a == b for a, b in zip(here, own, strict=False)) / len(own)
                if held >= licenses.SHARE and all(any(here[j : j + len(k)] == k for j in range(len(here))) for k in keys):
                    labels.add(label)
                    score = max(score, held)
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None))
        assert (x["base_labels"], x["labels"], round(x["score"], 9)) == (",".join(sorted({y for _, y in base})), ",".join(sorted(labels)), round(score, 9))


def plain_order_minhash(text):
    """The definition in whole numbers, one k-mer after another."""
    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
        return x ^ (x >> 31)

    mask = M ^ ((1 << fingerprints.PLACE_BITS) - 1)
    k = min(fingerprints.KMER, len(text))
    seen, rows = Counter(), []
    for place in range(len(text) - k + 1):
        h = 0
        for c in text[place : place + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M
        rows.append((mix((h + k) & M) & mask, place))
    rows.sort()
    numbered = []
    for at, (h, place) in enumerate(rows):
        numbered.append((mix((h + seen[h] * 0xD6E8FEB86659FD93) & M) & mask, at, place))
        seen[h] += 1
    numbered.sort()
    out = []
    for bucket in range(fingerprints.BUCKETS):
        start = sum(x[0] < bucket << 58 for x in numbered)
        taken = [numbered[(start + j) % len(numbered)] for j in range(fingerprints.TUPLE)]
        value = 0
        for h, _, _ in sorted(taken, key=lambda x: x[2]):
            value = mix((value * 31 + h + 1) & M)
        out.append(value >> 48)
    return out


def test_op7_signatures():
    rng = random.Random(32)
    for text in ("a", "ab" * 40, "x" * 100, *("".join(rng.choice("abcdé 日") for _ in range(rng.randint(1, 300))) for _ in range(40))):
        assert fingerprints.order_minhash(text).tolist() == plain_order_minhash(text)


def test_op8_score(spark):
    rng = random.Random(33)
    words = ["the", "theme", "cat", "catalog", "zq", "déjà", "日本", "re-read", "a" * 45, "Running"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), i % 4 > 0) for i in range(24)]
    got = {x["doc_id"]: x["score"] for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    scores = lm_score.vocabulary()
    counts, ends = Counter(w for _, t, train in rows if train for w in re.findall(SPACED, low(t))), sum(train for *_, train in rows)
    weights = scores
    for _ in range(lm_score.ROUNDS):
        one, each = lm_score.Lattice(weights), defaultdict(float)
        for w, c in counts.items():
            text = lm_score.MARK + w
            edges = one.edges(text)
            before, after = one.forward(edges), [0.0] * len(text) + [1.0]
            for i in range(len(text) - 1, -1, -1):
                after[i] = sum(math.exp(v) * after[j + 1] for j in range(len(text)) for s, v, _ in edges[j] if s == i)
            for j in range(len(text)):
                for s, v, piece in edges[j]:
                    share = c * math.exp(before[s] + v) * after[j + 1] / after[0]
                    for p in [piece] if piece in scores else [f"<0x{b:02X}>" for b in piece.encode()]:
                        each[p] += share
        each[lm_score.END] += ends
        total = sum(each.values()) + lm_score.PRIOR
        weights = {p: math.log((each[p] + lm_score.PRIOR * math.exp(scores[p])) / total) for p in scores}
    one = lm_score.Lattice(weights)
    for i, text, _ in rows:
        want = weights[lm_score.END] + sum(one.log_probability(w) for w in re.findall(SPACED, low(text)))
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-6)


def test_op1_fusion(spark):
    rng = random.Random(34)
    own = {"en": "the of and that with this from have which there", "de": "der die und das nicht mit eine auf werden nach", "fr": "les des que dans pour une est sur avec nous"}
    labelled = [(i, " ".join(rng.choices(own[k].split(), k=20)), k) for i, k in enumerate(("en", "de", "fr") * 20)]
    asked = []
    for i in range(90):
        k = rng.choice(list(own))
        text = rng.choice((" ".join(rng.choices(own[k].split(), k=rng.choice((1, 3, 12)))), "", None, "123 456", "xqzwv kjqxz"))
        asked.append((i, text, rng.choice((k, "fr", "xx", None)), rng.choice(("de", "fr", "com", None)), rng.choice(("h1", "h2", "h3", "", None)), rng.choice(("d1", "d2"))))
    docs = spark.createDataFrame(labelled, "id long, text string, lang string")
    langs, logs = language.models(docs)
    n = len(langs)
    start = [math.log((1 - language.UND_PRIOR) / (n - 1))] * (n - 1) + [math.log(language.UND_PRIOR)]
    heard = {}
    for i, text, declared, suffix, host, domain in asked:
        tri = language.trigrams(text)
        v = [sum(logs[k][t] for t in tri) / max(1, len(tri)) * min(len(tri), language.LONGEST) * language.TEMPER for k in range(n)]
        for told, trust in ((declared, language.DECLARED_TRUST), (language.SUFFIXES.get(suffix or ""), language.SUFFIX_TRUST)):
            if told in langs:
                v = [x + math.log(trust if langs[k] == told else (1 - trust) / (n - 1)) for k, x in enumerate(v)]
        heard[i] = [x - max(v) for x in v]
    soft = {}
    for i, v in heard.items():
        w = [math.exp(x + s) for x, s in zip(v, start, strict=True)]
        soft[i] = [x / sum(w) for x in w]
    places = {i: (domain, host or "") for i, _, _, _, host, domain in asked}
    overall = [(sum(s[k] for s in soft.values()) + 1) / (len(soft) + n) for k in range(n)]
    got = {x["id"]: x for x in language.identify(spark.createDataFrame(asked, "id long, text string, declared string, suffix string, host string, domain string"), docs).collect()}
    for i, (domain, host) in places.items():
        prior = overall
        if host:
            of_domain = [s for j, s in soft.items() if places[j][0] == domain and j != i]
            of_host = [s for j, s in soft.items() if places[j] == (domain, host) and j != i]
            for rows in (of_domain, of_host):
                prior = [(sum(s[k] for s in rows) + language.SMOOTH * prior[k]) / (len(rows) + language.SMOOTH) for k in range(n)]
        v = [x + math.log(p) for x, p in zip(heard[i], prior, strict=True)]
        mass = sum(math.exp(x - max(v)) for x in v)
        assert got[i]["probability"] == pytest.approx(1 / mass, abs=1e-4)
        if 1 / mass > 0.52:
            assert got[i]["lang"] == langs[int(np.argmax(v))] and got[i]["accepted"] == (got[i]["lang"] != language.UND)


def test_op1_domains(spark):
    urls = [(1, "https://a.b.example.co.uk/x", "example.co.uk"), (2, "http://www.example.de", "example.de"), (3, "http://co.uk/", "co.uk"), (4, "https://shop.example.com.br:80", "example.com.br"), (5, "x", "")]
    pages = spark.createDataFrame([(i, u, "") for i, u, _ in urls], "page_id long, url string, html string")
    assert {x["id"]: x["domain"] for x in language.of_pages(pages).collect()} == {i: d for i, _, d in urls}


def test_op10_learns_nothing_from_held_out_labels(spark):
    rng = random.Random(35)
    rows = [(i, " ".join(rng.choice(("plain", "words", "of", "text", f"w{rng.randrange(50)}")) for _ in range(40)) + (" zzugly vvrotten zzugly" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.drop("text")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    of = lambda known: {x["doc_id"]: x["score"] for x in toxicity.score(df.drop("toxic"), known).collect()}
    assert of(labels) == of(wrong)


def test_odd_rows_have_the_results_that_are_stated(spark, odd):
    """Null, empty and blank texts; repeated and clashing rows: row for row, whatever other columns are called."""
    plain = odd.select("doc_id", "text")
    rows = lambda df: sorted(map(repr, df.collect()))
    labels = spark.createDataFrame([(5, 1), (9, 0), (8, 1), (10, 0), (4, 0), (7, 1)], "doc_id long, toxic int")
    for scan in (licenses.scan, secrets.scan, neardup.near_duplicates, fingerprints.fingerprints, lambda d: lm_score.score(d.withColumn("train", F.lit(True))), lambda d: toxicity.score(d, labels)):
        assert rows(scan(odd)) == rows(scan(plain)) and len(rows(scan(odd))) == odd.count()
    near = {(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(odd).where("doc_id in (1, 2, 3, 4, 6, 7, 9)").collect()}
    assert near == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (6, 8996, 5, False), (7, 2, 7, True), (9, 1, 9, True)}
    found = {x["doc_id"]: (x["n_words"], x["n_base"], x["labels"], x["score"]) for x in licenses.scan(odd).where("doc_id in (1, 2, 7)").collect()}
    assert found[1] == found[2] == (0, 0, "", 0.0) and found[7][:3] == (6, 1, "mit")
    prints = {x["doc_id"]: x["fingerprint"] for x in fingerprints.fingerprints(odd).collect()}
    assert prints[1] == prints[2] == "0" * 256 and prints[5] == prints[6] != prints[9]


def test_ties_go_one_way(spark):
    """Equal texts and equal sizes, dealt out differently, give the same rows."""
    rng = random.Random(36)
    texts = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(10)]
    rows = [(i, texts[i % 10]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for scan in (neardup.near_duplicates, fingerprints.edits_and_neighbours, lambda d: lm_score.score(d.withColumn("train", F.lit(True))).withColumn("score", F.round("score", 6)).withColumn("base_score", F.round("base_score", 6))):
        assert sorted(map(repr, scan(df.repartition(3)).collect())) == sorted(map(repr, scan(df.repartition(7)).collect()))
