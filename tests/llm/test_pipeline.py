"""The pipeline against a plain version of its stages, and its stages on odd rows."""

import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import ALNUM, linked_by_brute_force, low

DATA = "/root/testdata/sf0.001"
OWN = {"en": "the of and that with this from have which there people between through", "de": "der die und das nicht mit eine auf werden nach haben zwischen durch"}


def corpus():
    """documents and benchmark with something for every stage to find."""
    rng = random.Random(40)
    some = lambda k, n: [rng.choice(OWN[k].split()) + rng.choice(("", "e", "en", "s")) for _ in range(n)]
    items = [(i, " ".join(some("en", 25))) for i in range(3)] + [(3, "a short one"), (4, None)]
    rows = []
    for i in range(60):
        k = ("en", "de")[i % 2]
        rows.append((i, some(k, rng.randint(40, 200)), k))
    for i in range(60, 80):  # near and exact copies
        words = list(rows[i - 60][1])
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, words, rows[i - 60][2]))
    rows = [(i, " ".join(w), k) for i, w, k in rows]
    rows += [(80 + i, " ".join(some("en", 30)) + " " + items[i % 4][1].upper() + " " + " ".join(some("en", 30)), "en") for i in range(8)]
    rows += [(90 + i, " ".join(some("de", 60)) + " AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) + " password = hunter2hunter2, " + " ".join(some("de", 5)), "de") for i in range(4)]
    rows += [(100 + i, " ".join("".join(rng.choices("qxzjkwvýþð", k=9)) for _ in range(80)), "en") for i in range(5)]
    rows += [(110, None, "en"), (111, "", "de")]
    return rows, items


def windows(text):
    w = re.findall(ALNUM, low(text))
    return [w[k : k + 10] for k in range(max(1, len(w) - 9) if w else 0)]


def test_run_is_the_plain_version(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, k, f"src{i % 3}", len(t) if t is not None else None) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [corpus_pipeline.run(spark, str(tmp_path)).collect() for _ in range(2)]
    assert {(x["doc_id"], x["start"], x["ids_crc32"]) for x in out[0]} == {(x["doc_id"], x["start"], x["ids_crc32"]) for x in out[1]}
    kept = {i: t for i, t, _ in rows if not 100 <= i < 105}  # texts of no language
    kept = {i: kept[i] for i, first in linked_by_brute_force(list(kept.items())).items() if i == first}
    asked = [win for _, text in items for win in windows(text)]
    for i in list(kept):
        w = re.findall(ALNUM, low(kept[i]))
        if any(w[p : p + len(win)] == win for win in asked for p in range(len(w) - len(win) + 1)):
            del kept[i]
    assert 20 < len(kept) < 80 and not any(80 <= i < 88 for i in kept)
    known = r"AKIA[A-Z0-9]{12,}|password = hunter2hunter2"
    encode, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for x in out[0]:
        pieces[x["doc_id"]].append(x)
    assert set(pieces) == set(kept)
    for i, text in kept.items():
        ids = encode.encode(re.sub(known, "[secret]", text or ""), add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda x: x["start"])
        assert [x["start"] for x in own] == [sum(y["length"] for y in own[:k]) for k in range(len(own))] and sum(x["length"] for x in own) == len(ids)
        for x in own:
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())


def test_stages_keep_what_they_should(spark):
    from veritrail.llm import decontaminate, neardup
    from veritrail.llm.common import table

    docs = table(spark, DATA, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    kept = corpus_pipeline.language_id(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    once = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert {x["doc_id"] for x in once.collect()} == {x["doc_id"] for x in neardup.near_duplicates(docs).where("kept").collect()}
    clean = {x["doc_id"] for x in corpus_pipeline.decontamination(spark, docs, DATA).collect()}
    assert clean == {x["doc_id"] for x in docs.collect()} - {x["doc_id"] for x in decontaminate.decontaminate(docs, table(spark, DATA, "benchmark")).where("n_hit > 0").collect()}
    masked = corpus_pipeline.secret_scan(spark, docs, DATA)
    assert masked.count() == docs.count() and masked.where(F.col("n_chars") != F.length("text")).count() == 0
    assert masked.where("text rlike '[0-9a-f]{32}'").count() == 0


def test_kept_documents_do_not_hang_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        assert len({frozenset(x["doc_id"] for x in stage(spark, docs.repartition(n), DATA).collect()) for n in (1, 6)}) == 1


def test_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    ids = lambda df: sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    every = ids(docs)
    assert ids(stages["language_id"](spark, docs, DATA)) == every  # no labelled text: nothing is rejected
    assert ids(stages["near_dedup"](spark, docs, DATA)) == [x for x in every if x not in ((False, 6), (False, 10))]  # copies of 5, exact and near
    assert ids(stages["decontamination"](spark, docs, DATA)) == every
    same = stages["secret_scan"](spark, docs, DATA)
    assert same.columns == docs.columns and sorted(map(repr, same.drop("n_chars").collect())) == sorted(map(repr, docs.drop("n_chars").collect()))
    assert {x for x in ids(stages["packing"](spark, docs, DATA))} == set(every)


def test_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path))
    assert left.count() == 0 and left.columns[:3] == ["doc_id", "start", "length"]
