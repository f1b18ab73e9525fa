"""Suffix buckets over bytes and relative factors over words, against all windows by brute force."""

import numpy as np
import pytest
from helpers import bytes_brute, odd_rows, prose, table, words_brute

from segflow.llm import factors, suffixes

LIMITS = [{}, {"hot_rows": 5, "bucket_rows": 100}, {"hot_rows": 1}, {"bucket_rows": 10}]


@pytest.mark.parametrize("limits", LIMITS)
def test_bytes(spark, limits):
    rows = odd_rows()
    found = suffixes.suffix_digest(table(spark, rows), **limits).collect()
    assert sorted(map(tuple, found), key=repr) == bytes_brute(rows)


@pytest.mark.parametrize("limits", LIMITS)
def test_words(spark, limits):
    rows = odd_rows()
    found = factors.factor_digest(table(spark, rows), **limits).collect()
    assert sorted(map(tuple, found), key=repr) == words_brute(rows)


def test_hot_grams_in_texts_of_several_chunks(spark):
    passage = prose(500, 60)
    rows = [(i, f"{prose(i, 1000 + 30 * i)} x{i} {passage} y{i} {prose(1000 + i, 4000 - 30 * i)}") for i in range(100)]
    docs = table(spark, rows).coalesce(1)
    found = factors.factor_digest(docs, hot_rows=20).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {i: 60 if i else 0 for i in range(100)}
    assert sorted(found) == sorted(factors.factor_digest(docs).collect())
    assert sorted(suffixes.suffix_digest(docs, hot_rows=20).collect()) == sorted(suffixes.suffix_digest(docs).collect())
    edited = {r["doc_id"]: r["text"] for r in factors.without_repeats(docs, hot_rows=20).collect()}
    assert edited[0] == rows[0][1] and all(edited[i] == rows[i][1].replace(f" {passage}", "") for i in range(1, 100))


def test_empty_tables(spark):
    assert suffixes.suffix_digest(table(spark, [])).collect() == []
    assert factors.factor_digest(table(spark, [])).collect() == []
    assert factors.without_repeats(table(spark, [])).collect() == []


def test_texts_without_repeats_keep_columns(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    out = factors.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[3]["text"] == dict(rows)[3] and by_id[5]["text"] == "" and by_id[5]["n_chars"] == 0
    assert by_id[9]["text"] is None and by_id[11]["text"] == "   \n\t "


def test_multikey_sort():
    draw = np.random.default_rng(3)
    raw = draw.integers(0, 2, (400, 24)).astype(np.uint8)
    order, shared = suffixes.multikey_sort(suffixes._tokens(raw))
    rows = [bytes(raw[i]) for i in order]
    assert rows == sorted(rows)
    for i in range(1, len(rows)):
        same = next((k for k, (a, b) in enumerate(zip(rows[i - 1], rows[i])) if a != b), 24)
        assert shared[i] == same
