"""Extra columns with clashing names, and empty tables, for operators whose other tests have none."""

import pytest

from quire.llm import byte_bpe, chat, lm_scoring, sharding, url_filter

DOCS = "doc_id long, text string"
ROWS = [(1, "one two three one two"), (2, None), (None, "one"), (3, ""), (3, "two one")]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x"), (2, None), (2, "x")], "page_id long, url string")
    rules = {"example.org/es/": "block"}
    assert same(url_filter.filter_urls(pages, rules), url_filter.filter_urls(pages.selectExpr("'h' AS host", "1 AS path", "page_id", "2 AS rule", "url", "3 AS verdict"), rules))


def test_byte_bpe(docs):
    vocabulary = byte_bpe.public_vocabulary()
    plain = byte_bpe.encode(docs, *vocabulary)
    clashing = docs.selectExpr("'x' AS ids", "doc_id", "1 AS n_tokens", "text", "2 AS decoded", "3 AS other")
    got = byte_bpe.encode(clashing, *vocabulary)
    assert got.columns == ["doc_id", "text", "other", "n_tokens", "ids", "decoded"] and same(plain, got.select(*plain.columns))


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    clashing = turns.selectExpr("*", "1 AS d", "2 AS part", "3 AS bucket", "4 AS n_turns", "5 AS h1", "6 AS length", "7 AS at")
    assert same(chat.format_chats(turns), chat.format_chats(clashing)) and chat.format_chats(turns).count() == 1


def test_lm_scoring(spark, docs):
    good = spark.createDataFrame([(1,)], "doc_id long")
    clashing = docs.selectExpr("1 AS n_tokens", "doc_id", "2 AS loss_target", "text", "3 AS target", "4 AS score")
    assert same(lm_scoring.score(docs, good), lm_scoring.score(clashing, good))
    assert lm_scoring.score(docs.limit(0), good).count() == 0 and lm_scoring.score(docs, good.limit(0)).count() == len(ROWS)


def test_sharding(docs):
    clashing = docs.selectExpr("1 AS size", "doc_id", "2 AS shard", "text", "3 AS slot", "4 AS bucket", "5 AS key", "6 AS rank")
    assert same(sharding.shard(docs, [1.0] * 3), sharding.shard(clashing, [1.0] * 3)) and sharding.shard(docs.limit(0), [1.0] * 3).count() == 0
