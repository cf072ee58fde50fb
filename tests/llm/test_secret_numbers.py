"""Numbers beside sensitive words, and how far a sensitive word reaches."""

import random

import pytest

from notegraph.llm import secrets

KEY = "".join(random.Random(3).choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=32))


def novel(text, near=secrets.NEAR):
    return [text[s:e] for s, e, _ in secrets.novel_spans(text, secrets.base_spans(text), near)]


@pytest.mark.parametrize("text", [
    "the secret of card 4929123412341234 was out", "his password, order 20240115093312345, was lost", "token count 1234567890123456", "bearer of 4111111111111111",
    "client_id list 2024-01-15-1234567890", "a credential for account 98765432109876543210 here",
])
def test_numbers_near_a_word_are_no_secrets(text):
    assert novel(text) == []


@pytest.mark.parametrize("text", ["the token is 8301947561029384", "passphrase: 5930174826450918273"])
def test_numbers_said_to_be_the_secret_are(text):
    assert len(novel(text)) == 1


def test_reach_is_a_parameter():
    text = "the bearer credential" + " filler" * 12 + " " + KEY
    assert novel(text) == [] and novel(text, 200) == [KEY]


def test_long_runs_are_measured_like_short_ones():
    long = "".join(random.Random(5).choices("0123456789abcdefghijklmnopqrstuvwxyz", k=3000))
    assert novel(f"bearer {long}") == [long]
    assert novel("bearer " + "abcdefgh1" * 300) == []


def test_scan_with_a_wider_reach(spark):
    docs = spark.createDataFrame([(1, "the bearer credential" + " filler" * 12 + " " + KEY), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_novel for r in secrets.scan(docs, 200).collect()} == {1: 1, 2: 0}
    assert {r.doc_id: r.n_novel for r in secrets.scan(docs).collect()} == {1: 0, 2: 0}
