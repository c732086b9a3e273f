"""What the findings of the second round were about: a worker's memory, calls of the tokenizer, pairs beside a large group."""

import gc
import random
import weakref

import numpy as np
import pytest

pytest.importorskip("lamella.llm")

from lamella.llm import common, ngram_join, tokenise, words  # noqa: E402


def test_a_worker_keeps_one_memo():
    held = weakref.ref(tokenise.encoder(tokenise.vocabulary("byte_bpe_50k.json"), True))
    assert tokenise.encoder(tokenise.vocabulary("byte_bpe_50k.json"), True) is held()
    memo = words.memo()
    gc.collect()
    assert held() is None and words.memo() is memo
    common.drop_kept()
    assert words.memo() is not memo


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_new_chunks_of_many_texts_are_encoded_together(name, spaces):
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdeé", k=r.randrange(1, 9))) + r.choice(["", "", ".", ",)"]) for _ in range(30)) for _ in range(200)]
    coder, whole, calls = tokenise.ChunkEncoder(tokenise.vocabulary(name), spaces), Tokenizer.from_file(tokenise.vocabulary(name)), []
    ids = coder._ids
    coder._ids = lambda text: calls.append(text) or ids(text)
    got = dict(coder.encode_all(enumerate(texts)))
    assert len(calls) <= 8
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pairs_beside_a_large_group_are_formed_once(spark, monkeypatch):
    def edited(seed, places):
        r = random.Random(seed)
        text = [f"w{i}" for i in range(400)]
        for k in range(places):
            text[(k * 400 // places) + r.randrange(3)] = f"x{seed}_{k}"
        return " ".join(text)

    docs = [(i, edited(i, 2)) for i in range(40)] + [(100 + i, edited(100 + i, 17)) for i in range(10)]
    monkeypatch.setattr(ngram_join, "may_link", lambda: ngram_join.fits())  # the bitmaps would drop these short texts
    formed, spool, main_pairs = [], ngram_join.spool, ngram_join.main_pairs
    monkeypatch.setattr(ngram_join, "main_pairs", lambda *x: formed.append(spool(main_pairs(*x), "formed")) or formed[0])
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in docs}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    want = {i: i for i in sets}
    for _ in sets:
        for i, j in linked:
            want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(want.values())) > 1
    assert 0 < formed[0].count() == formed[0].distinct().count()
