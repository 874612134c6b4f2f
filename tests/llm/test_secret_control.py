"""The secret scan's false-discovery control: texts of paths, URLs and prose, planted keys, thresholds by a plain version."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import secrets

WORDS = "alpha project internal secretary handbook meeting of the finance report quarterly review deploy service customer account number invoice total office street winter garden music letter nothing happened where people thought again".split()


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == 3] for x in secrets.scan(rows).collect()}


@pytest.fixture(scope="module")
def told():
    rng = random.Random(9)
    w = lambda: rng.choice(WORDS)
    path = lambda: f"{w()}/{w()}-{w()}-{w()}{rng.choice(['', '_v2', '2021'])}"
    prose = lambda n: " ".join(w() for _ in range(n))
    url = lambda: f"https://{w()}.com/{w()}/{w()}-{w()}?q={w()}{w()}{w()}&id={rng.randint(1, 10**9)}"
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    return path, prose, url, key


def test_texts_without_keys(spark, told):
    path, prose, url, _ = told
    makers = {
        "one path": lambda k: "word/alpha-project-internal", "paths": lambda k: path(), "paths after prose": lambda k: f"{prose(20)} {path()}", "some after prose": lambda k: path() if k % 2 else f"{prose(20)} {path()}",
        "urls": lambda k: url(), "urls in prose": lambda k: f"{prose(9)} {url()} {prose(5)}", "prose": lambda k: prose(60), "camel": lambda k: "".join(x.title() for x in prose(4).split()) + (" " + prose(9)) * (k % 2),
    }
    for name, make in makers.items():
        found = scanned(spark, [make(k) for k in range(400)])
        assert sum(map(bool, found.values())) <= (0 if name in ("one path", "paths") else 4), name


def test_planted_keys(spark, told):
    path, prose, _, key = told
    keys = [key() for _ in range(30)]
    for put in (lambda x: f"{x} {prose(30)}", lambda x: f"{prose(30)} {x}"):
        found = scanned(spark, [put(x) for x in keys] + [f"{prose(30)} {path()}" for _ in range(300)])
        assert sum(b - a >= 38 for k in range(30) for a, b in found[k]) == 30
        assert sum(bool(found[k]) for k in range(30, 330)) <= 3


def test_beside():
    data = b"one two KEYKEYKEY three four"
    of = lambda n: secrets.beside(data, 8, 17, n).tobytes()
    assert of(4) == b"etwo" and of(6) == b"onetwo" and of(7) == b"threefo" and of(9) == b"threefour" and of(99) == b"threefour"
    assert secrets.beside(b"a" + b" " * 500 + b"KEY", 501, 504, 1).tobytes() == b"a"
    assert len(secrets.beside(b"KEY", 0, 3, 5)) == 0


def test_thresholds_by_a_plain_version(spark, told):
    path, prose, url, key = told
    rng = random.Random(3)
    texts = [rng.choice([path, url, lambda: prose(30), lambda: f"{key()} {prose(4)}", lambda: f"{prose(12)} {path()} {key()}", key])() for _ in range(500)]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(secrets.tested(F.col("text")).alias("spans"))
    runs = [s for x in found.collect() for s in x["spans"] if s["kind"] == 3]
    classes = {(s["encoding"], math.floor(math.log2(s["size"]) * 8)) for s in runs}
    want = {}
    for encoding, length in classes:
        own = [s["level"] for s in runs if (s["encoding"], math.floor(math.log2(s["size"]) * 8)) == (encoding, length)]
        shorter = [(s["encoding"], math.floor(math.log2(s["size"]) * 8), s["decoy"]) for s in runs if s["decoy"] is not None]
        pools = [[d for e, n, d in shorter if e == encoding and length - 4 < n <= length], [d for e, n, d in shorter if e == encoding and n <= length], [d for e, n, d in shorter if n <= length]]
        pool = next((x for x in pools if x and len(x) >= 0.1 * len(own)), None)
        if not pool:
            continue
        upper = max(v for v in range(secrets.LEVELS) if sum(d >= v for d in pool) >= 0.1 * len(pool))
        tail = [d - upper for d in pool if d >= upper]
        for least in range(secrets.LEVELS):
            n, m = sum(v >= least for v in own), sum(d >= least for d in pool)
            doubt = math.exp(-max(0, least - max(pool)) / (1 + sum(tail) / len(tail))) / (len(pool) + 1)
            if n and len(own) * (m / len(pool) + doubt) <= 0.01 * n:
                want[encoding, length] = least
                break
    assert want and secrets.thresholds(found) == want
    assert secrets.levels_of({}) == {} and secrets.levels_of({("hex", 40): np.zeros((2, secrets.LEVELS), np.int64)}) == {}
