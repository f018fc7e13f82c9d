"""The pipeline, stage by stage, against brute force on a small folder of tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from keyloom.llm import byte_bpe, jaccard_join, toxicity
from keyloom.llm.common import shuffles_removed, stored
from tests.llm.test_operators import brute_groups, brute_windows, edited, prose

SECRET = "token = \"0123456789abcdef0123456789abcdef\""


def tables(spark, root):
    base, item = prose(900, 150), prose(901, 40)
    docs = [(i, prose(i, 120), "clean") for i in range(300)]
    docs += [(1000 + i, prose(2000 + i, 80) + " you idiot moron " + prose(3000 + i, 20), "toxic") for i in range(100)]
    docs += [(1200 + i, edited(base, i, 1), "copy") for i in range(12)]
    docs += [(1300 + i, prose(4000 + i, 10) + " " + item, "leak") for i in range(3)]
    docs += [(1400 + i, prose(5000 + i, 60) + " " + SECRET + " " + prose(6000 + i, 60), "secret") for i in range(3)]
    docs += [(1500, None, "clean"), (1501, "", "clean")]
    spark.createDataFrame([(i, t, "en", kind, 1) for i, t, kind in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(kind == "toxic")) for i, t, kind in docs if kind in ("clean", "toxic") and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs, [(1, item), (2, None)]


def test_pipeline(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    kept = [(i, t) for i, t, kind in docs if kind != "toxic"]
    groups = brute_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    hit = brute_windows(kept, items)
    kept = [(i, t) for i, t in kept if not (hit[i][1] and 20 * hit[i][1] >= hit[i][0])]
    kept = [(i, t.replace(SECRET[:-1], "[SECRET]") if t else t) for i, t in kept]
    path, pattern = byte_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(40)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("score", [0.29, 0.3, 0.4, 0.5])
def test_toxicity_stage_agrees_with_the_verdict(spark, tmp_path, monkeypatch, score):
    tables(spark, str(tmp_path))
    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity.Model(pa.array([], pa.string()), np.zeros(0), score))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(20)
    verdicts = {r["predicted"] for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect()}
    assert verdicts == {int(score >= 0.3)}
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == (20 if verdicts == {0} else 0)


def test_rows_that_share_an_id_stay_or_go_together(spark, tmp_path):
    text, other = prose(1, 60), prose(2, 60)
    rows = [(1, text), (1, text), (2, text), (2, text), (None, text), (3, other), (None, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    left = corpus_pipeline.without_near_copies(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([r for r in rows if r[0] != 2], key=str)


def test_near_copies_of_a_large_block_are_sent_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = random.Random(72)
    pool = [" ".join(f"w{rng.randrange(5000)}" for _ in range(10)) for _ in range(20)]
    texts = [(i, " ".join(rng.choice(pool) for _ in range(14))) for i in range(600)]  # one block, few links
    texts += [(1000 + i, texts[i][1] + " tail") for i in range(0, 600, 20)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    left = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    groups = brute_groups(texts)
    assert sorted(r["doc_id"] for r in left) == sorted(i for i, _ in texts if groups[i][1] == i)
    assert written() - before < 8 * 8 * sum(n for n, _ in groups.values())


def copied_texts():
    """Twelve near copies of each of 60 texts; every passage at their ends is in three of the texts."""
    texts = [prose(100 + i, 70) + " " + prose(500 + i // 3, 15) + " " + prose(600 + (i + 1) // 3, 15) for i in range(60)]
    return [(100 * i + k, edited(text, 100 * i + k, 1)) for i, text in enumerate(texts) for k in range(12)]


def test_blocks_of_near_copies_stay_apart_from_texts_that_share_passages(spark, tmp_path, monkeypatch):
    largest, own = [], jaccard_join._blocks
    monkeypatch.setattr(jaccard_join, "_blocks", lambda blocks, *a: (largest.append(max(r["count"] for r in blocks.groupBy("component").count().collect())), own(blocks, *a))[1])
    texts = copied_texts()
    left = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), str(tmp_path)).collect()
    groups = brute_groups(texts)
    assert sorted(r["doc_id"] for r in left) == sorted(i for i, _ in texts if groups[i][1] == i) and len(left) == 60
    assert largest == [12]


@pytest.mark.parametrize("block", [512, 1])
def test_sets_of_near_copies_are_sent_in_turns(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 1: every block is dealt into parts
    texts = [(1000 * k + i, edited(prose(100 + i, 150), 1000 * k + i, 1)) for k in range(2) for i in range(300)]  # every set is in a block
    sc, sent, own = spark.sparkContext._jsc.sc(), [], jaccard_join.stored

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    def stored(df, label, *more):
        before = written()
        out = own(df, label, *more)
        sent.append((label, written() - before))
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    left = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), str(tmp_path)).collect()
    groups = brute_groups(texts)
    assert sorted(r["doc_id"] for r in left) == sorted(i for i, _ in texts if groups[i][1] == i) and len(left) == 300
    sets, links = 8 * sum(n for n, _ in groups.values()), [n for label, n in sent if label == "jaccard-links"]
    assert sum(links) > 0.8 * sets and max(links) < 0.5 * sets  # all are sent, but not at once


def test_the_driver_gives_free_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    native, pid = jvm.org.apache.spark.unsafe.Platform, jvm.java.lang.ProcessHandle.current().pid()

    def resident(addresses: list[int]) -> float:
        """MB in memory of the mappings that hold the addresses."""
        total, counts = 0, False
        with open(f"/proc/{pid}/smaps") as f:
            for line in f:
                if m := re.match(r"([0-9a-f]+)-([0-9a-f]+) ", line):
                    counts = any(int(m[1], 16) <= a < int(m[2], 16) for a in addresses)
                elif counts and line.startswith("Anonymous:"):
                    total += int(line.split()[1]) / 1024
        return total

    def given_back(step) -> float:
        """MB of 100 that the step gives back, free but for a few bytes in a hundred KB."""
        blocks = [(native.allocateMemory(98_304), native.allocateMemory(64)) for _ in range(1024)]
        large = [a for a, _ in blocks]
        for a in large:
            native.setMemory(a, 1, 98_304)
        for a in large:
            native.freeMemory(a)
        held = resident(large)
        step()
        left = resident(large)
        for _, small in blocks:
            native.freeMemory(small)
        return held - left

    def inside():
        with shuffles_removed(spark):
            pass

    assert given_back(inside) > 60
    assert given_back(lambda: stored(spark.range(1), "native")) > 60
