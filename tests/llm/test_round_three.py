"""What the findings of the third round were about: the driver's memory after a fit, chunks that need no Python object each."""

import random
import sys
import weakref

import numpy as np
import pytest

pytest.importorskip("lamella.llm")

from lamella.llm import tokenise, toxicity_chain  # noqa: E402


def test_the_driver_gives_back_what_a_fit_took(spark, monkeypatch):
    made, gone = [], []

    class Entries(toxicity_chain.Entries):
        def __init__(self, *x):
            super().__init__(*x)
            made.append(weakref.ref(self))

    monkeypatch.setattr(toxicity_chain, "Entries", Entries)
    monkeypatch.setattr(toxicity_chain, "give_back", lambda: gone.append([x() is None for x in made]))
    docs = spark.createDataFrame([(i, f"word{i % 3} of {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    toxicity_chain.fit_chain(docs, labels)
    assert gone[-1:] == [[True]]


def letters(k: int) -> str:
    """A different word for each number."""
    return "q" + "".join(chr(97 + int(x)) for x in str(k))


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_cost_no_call_each(name, spaces):
    coder = tokenise.ChunkEncoder(tokenise.vocabulary(name), spaces)
    texts = [" ".join(letters(100 * k + i) + "." * (i % 3) for i in range(100)) for k in range(80)]
    calls = []
    sys.setprofile(lambda frame, event, x: calls.append(1))
    try:
        got = dict(coder.encode_all(enumerate(texts)))
    finally:
        sys.setprofile(None)
    assert len(calls) < 8000  # there are 8000 words
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k], "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_of_uneven_and_odd_texts_among_others(name, spaces, monkeypatch):
    """Marks after letters and punctuation, case, special tokens, blanks side by side, and a memo that forgets."""
    r = random.Random(5)
    parts = ["J\u030c", "j\u030c", "e\u0301,", "\u00c9,x", "a=\u0338b", "\u0130.", "I\u0307!", "don't", "x's,", "O'Neil", "<|endoftext|>", "\x00", "\x01", "\t", "\u3000", "\n", "_a_", "a1.5", "ABC", "abc", "Abc###", "\u01f0", "\ufb01.", ""]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", " ", "  ", "", "\n"]) for _ in range(r.randrange(12))) for _ in range(600)]
    monkeypatch.setattr(tokenise, "MEMO_CHUNKS", 20)
    monkeypatch.setattr(tokenise, "TOGETHER", 400)
    coder = tokenise.ChunkEncoder(tokenise.vocabulary(name), spaces)
    for k, ids in coder.encode_all(enumerate(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == coder.tokenizer.encode(texts[k], add_special_tokens=False).ids, texts[k]
    assert len(coder.memo) <= 20


def test_case_makes_no_word_new_to_a_vocabulary_without_case():
    coder, new = tokenise.ChunkEncoder(tokenise.vocabulary("word_bpe_49k.json"), False), []
    ids = coder._ids
    coder._ids = lambda text: new.append(text) or ids(text)
    first = coder.encode("Some other words.")
    new.clear()
    assert coder.encode("some OTHER Words.") == first
    assert not any(x.strip() for x in new)
