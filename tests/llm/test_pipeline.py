"""The pipeline's stages against brute force on a small corpus, and on odd and empty tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lamella.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lamella.llm import source_mixing, toxicity_chain  # noqa: E402
from lamella.llm.common import crc32_of  # noqa: E402
from lamella.llm.tokenise import ChunkEncoder, vocabulary  # noqa: E402

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["moron", "scum", "fool"]


def corpus(seed=1, n=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, toxic = [], set()
    for i in range(n):
        if rows and r.random() < 0.35:
            t = r.choice(rows)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = r.choices(words, k=r.randrange(30, 90))
        if i % 5 == 0 and not set(t) & set(BAD):
            t[:8] = r.choices(BAD, k=8)
        if set(t) & set(BAD):
            toxic.add(i)
        text = r.choice([" ", "  ", "\n"]).join(t)
        rows.append((i, text, r.choice(["en", "en", "de"]), f"src{r.choice([0, 0, 0, 1, 2])}", len(text)))
    return rows, toxic


def stored(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def shingle_set(t):
    w = t.encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def left_by_near(rows):
    """The smallest doc_id of each component of similar documents."""
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def left_by_mixing(rows, plan, seed):
    out = set()
    for node in plan:
        members = [(i, len(t.split())) for i, t, lang, source, _ in rows if (lang or "") == node.language and (source or "") == node.origin]
        if node.epochs:
            out.update(i for i, _ in members)
            continue
        at = 0
        for i, n in sorted(members, key=lambda m: (int(hashlib.md5(f"{seed}:1:{m[0]}".encode()).hexdigest()[:15], 16), m[0])):
            if at >= node.rest:
                break
            out.add(i)
            at += n
    return out


def test_stages_by_brute_force(spark, tmp_path):
    rows, toxic = corpus()
    labels = [(i, int(i % 4 > 0), int(i in toxic)) for i in range(200)]
    sf = stored(spark, tmp_path, rows, labels)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_join", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    kept = stages["toxicity"](spark, docs, sf).collect()
    told = {r.doc_id for r in toxicity_chain.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("is_toxic").collect()}
    assert {r.doc_id for r in kept} == {i for i, *_ in rows} - told
    assert len(told ^ toxic) <= 3

    first = {}
    for i, t, *_ in sorted(tuple(r) for r in kept):
        first.setdefault(" ".join(t.split()), i)
    unique = stages["exact_dedup"](spark, spark.createDataFrame(kept, DOCUMENTS), sf).collect()
    assert sorted(r.doc_id for r in unique) == sorted(first.values())

    apart = stages["ngram_join"](spark, spark.createDataFrame(unique, DOCUMENTS), sf).collect()
    assert {r.doc_id for r in apart} == left_by_near([tuple(r) for r in unique]) and len(apart) < len(unique)

    aim = corpus_pipeline.MIXTURE
    near = spark.createDataFrame(apart, DOCUMENTS)
    plan = source_mixing.leaf_plan(source_mixing.counted(near, aim).groupBy(*aim.names).agg(F.sum("n_tokens").alias("tokens")), aim).collect()
    mixed = stages["source_mixing"](spark, near, sf).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(left_by_mixing([tuple(r) for r in apart], plan, aim.seed))

    coder, got = ChunkEncoder(vocabulary("byte_bpe_50k.json"), True), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(r)
    assert set(got) == {r.doc_id for r in mixed}
    for r in mixed:
        ids, at = [*np.frombuffer(coder.encode(r.text), "<u4").tolist(), 2], 0
        for p in sorted(got[r.doc_id], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == crc32_of(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_odd_rows(spark, tmp_path):
    some = " ".join(f"w{i}" for i in range(40))
    rows = [(1, some, "en", "s1", 1), (1, some, "en", "s1", 1), (2, some + " x", None, None, None), (None, None, None, None, None), (None, "", "en", "s1", 0), (3, None, "en", "s1", 0), (None, some + " y", "de", None, 2), (4, "word " * 30000, "en", "s1", 5), (5, "a b", "en", "s2", 3), (5, "c d", "en", "s2", 3)]
    sf = stored(spark, tmp_path, rows, [(None, 1, 1), (1, None, 0), (99, 1, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), DOCUMENTS)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "exact_dedup":  # equal texts leave one row; null and empty texts are equal
            assert docs.count() == 7
        if name == "ngram_join":  # the three texts of 40 words are near
            assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in docs.collect()) == [(1, "w0 "), (3, ""), (4, "wor"), (5, "a b"), (5, "c d")]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} <= {1, 3, 4, 5} and pieces


def test_empty_tables(spark, tmp_path):
    sf = stored(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
