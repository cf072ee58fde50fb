"""Deterministic ids: the first 16 hex digits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def make_id(*parts: Column) -> Column:
    return short_hash(F.concat_ws(":", *parts))


def doc_id(path: Column) -> Column:
    return make_id(F.lit("doc"), path)


def tag_id(name: Column) -> Column:
    return make_id(F.lit("tag"), name)


def segment_id(path: Column, raw: Column) -> Column:
    return make_id(path, short_hash(raw))


def cluster_id(pass_id: Column, label: Column) -> Column:
    """``label`` is the full label, ``parent_child`` for a child pass."""
    return make_id(F.lit("cluster"), pass_id, label)


def bridge_id(pass_id: Column, block: Column) -> Column:
    return make_id(F.lit("bridge"), pass_id, block)
