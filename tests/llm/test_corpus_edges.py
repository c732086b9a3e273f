"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest

pytest.importorskip("lamella.llm")

from lamella.llm import best_fit_packing, exact_dedup, media_sniff, ngram_join, secret_links, sharding, source_mixing, substring_dedup, toxicity_chain, wavelet_shards  # noqa: E402
from lamella.llm.tokenise import vocabulary  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, identity bigint, digest string, kind string, root int"
LONG = "word " * 30000 + "end"


def rows():
    some = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "a", "a", "one two three four", some, some, some + " more", LONG, "token = abcdef0123456789abcdef0123", "x\x0by\r\nz"]
    out = [(i, t, "en", "src1", 0, "k", 1, "d", "z", 2) for i, t in enumerate(texts)]
    out += [(3, "a", "en", "src1", 0, "k", 1, "d", "z", 2)] * 2  # repeated rows
    out += [(None, "a", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, x: toxicity_chain.classify(d, x),
    "secrets": lambda d, x: secret_links.scan(d),
    "mixing": lambda d, x: source_mixing.counted(d, source_mixing.Mixture()),
    "exact": lambda d, x: exact_dedup.duplicates(d),
    "sharding": lambda d, x: sharding.shards(d, [1.0] * 4),
    "media": lambda d, x: media_sniff.features(media_sniff.store(d)),
    "substring": lambda d, x: substring_dedup.deduplicated(d),
    "wavelet": lambda d, x: wavelet_shards.stored(d, vocabulary("word_bpe_49k.json")),
    "ngram": lambda d, x: ngram_join.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, labels, name):
    assert OPERATORS[name](docs, labels).count() == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, labels, name):
    assert OPERATORS[name](none, labels).count() == 0


def test_packing(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    got = best_fit_packing.packed(docs, path).collect()
    assert sum(r.piece == 0 for r in got) == len(rows())
    assert sum(r.length == 1 for r in got) >= 3  # null and empty texts have the end id only
    assert best_fit_packing.packed(none, path).count() == 0


def test_exact(docs):
    got = exact_dedup.duplicates(docs).collect()
    a = [r for r in got if r.keep_id == 3]
    assert len(a) == 5 and {r.group_size for r in a} == {5}
    assert sum(r.kept for r in a) == 1  # three repeated rows, one stays
    empty = [r for r in got if r.keep_id == 0]
    assert len(empty) == 3 and sum(r.kept for r in empty) == 1
    blank = [r for r in got if r.doc_id == 2]
    assert blank[0].kept and blank[0].group_size == 1  # one space is not empty


def test_drop_duplicates_keeps_columns(docs):
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3, 5, 6, 8, 9, 10, 11]


def test_sharding(docs):
    got = sharding.shards(docs, [1.0] * 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.size for r in got if r.doc_id == 0} == {16}


def test_ngram(docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got[(0, 0)] == 0 and got[(1, 0)] == 1 and got[(2, 0)] == 2  # empty sets link with nothing
    assert got[(4, 1)] == 3 and got[(None, 1)] == 3 and got[(5, 1)] == 5
    assert got[(7, 36)] == 6 and got[(8, 37)] == 6


def test_drop_near_duplicates(docs):
    got = ngram_join.drop_near_duplicates(docs.where("doc_id is not null"))
    assert got.columns == docs.columns
    assert sorted({r.doc_id for r in got.collect()}) == [0, 1, 2, 3, 5, 6, 9, 10, 11]


def test_substring(docs):
    got = {r.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    assert got[7].n_removed == 40 and got[7].kept == ""
    assert got[8].n_removed == 40 and got[8].kept == "more" and [(s.start, s.end) for s in got[8].repeats] == [(0, 40)]
    assert got[9].n_removed == 0 and got[0].n_words == 0 and got[4].n_removed == 0


def test_drop_near_duplicates_keeps_one_row_of_a_component(spark, docs):
    got = ngram_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, 0, 1, 2, 3, 5, 6, 9, 10, 11]  # the null text has no words
    p, q, r = (" ".join(f"{c}{i}" for i in range(40)) for c in "pqr")
    texts = [(1, p), (2, p + " x"), (2, r), (None, p + " y"), (None, q), (None, q + " x"), (None, q), (4, "a b"), (4, "A  b"), (4, "a b"), (None, None), (None, "")]
    left = ngram_join.drop_near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower().split()[:1]) for r in left) == [(0, []), (0, []), (0, ["q0"]), (1, ["p0"]), (2, ["r0"]), (4, ["a"])]


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_texts_that_share_a_doc_id(spark, parts):
    p, q, r, s = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqrs")
    texts = [(1, p + " one"), (2, q + " two"), (5, p + " five"), (5, r + " other"), (5, q + " " + s)]
    texts += [(7, r + " seven"), (8, s + " eight"), (None, p + " nil"), (None, q + " none"), (None, r + " null")]
    alone = " ".join(f"u{i}" for i in range(20))
    texts += [(None, alone + " a"), (None, alone + " b"), (9, alone[:-3] + "x y"), (9, alone[:-3] + "z w")]
    got = substring_dedup.deduplicated(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(parts)).collect()
    found = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept or "") for r in got)
    kept = {(5, 21, 20, "five"), (5, 21, 0, ""), (5, 40, 20, s), (7, 21, 20, "seven"), (8, 21, 20, "eight"), (99, 21, 20, "nil"), (99, 21, 20, "none"), (99, 21, 20, "null")}
    assert found == sorted([(1, 21, 0, ""), (2, 21, 0, ""), *kept, (9, 21, 0, ""), (9, 21, 0, ""), (99, 21, 19, "u19 a"), (99, 21, 19, "u19 b")])


def test_mixture_takes_all_of_a_large_budget(docs):
    aim = source_mixing.Mixture(budget=(1, 1), max_epochs=1)
    got = source_mixing.select_documents(docs, aim)
    assert got.columns == docs.columns
    assert got.where("doc_id = 9").count() == 1


def test_mixture_of_odd_rows(docs):
    got = source_mixing.mixture(docs).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()} and all(r.epoch in (1, 2) for r in got)
    assert max(r.n_tokens for r in got) == 30001


def test_empty_mixture(none):
    assert source_mixing.mixture(none).count() == 0


def test_capitals_are_counted_in_the_whole_text():
    for text in ("", "A", "aB", "x" * 6 + "ABCDEF", "Ünd ÄÖ \U00010400 \ud800 ǅ", "aB" * 50000):
        share = toxicity_chain.shares(text, text.split())[0]
        assert share == sum(c.isupper() for c in text) / max(1, len(text))


def test_reject_toxic_keeps_columns(docs, labels, none):
    assert toxicity_chain.reject_toxic(docs, labels).columns == docs.columns
    assert toxicity_chain.reject_toxic(docs, labels.limit(0)).count() == len(rows())
