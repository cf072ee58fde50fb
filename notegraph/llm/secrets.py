"""Secret scans: three base patterns, and dictionary-primed zstandard novelty for the rest.

Base spans, leftmost non-overlapping per kind (``assign``, ``access``, ``hex``), always stay. Besides them every whole run of
``LEAST`` or more token characters is a candidate if a sensitive word is in it or at most ``NEAR`` characters before or behind
it (that is what sensitive context means here; ``near`` of :func:`scan`). The candidate is compressed by zstandard primed with a raw
dictionary: common identifiers, then the text around it. What that adds in bytes beyond an empty frame is what neither
the surroundings nor the identifiers explain. A candidate is reported as ``novel`` if it, a part of ``WINDOW`` characters or
a part between its separators adds at least the share ``NOVEL`` of what random text of its length over its alphabet (the smallest of
``ALPHABETS`` that holds it) adds. Known words, paths and repeated names cost a fraction of that. Two sorts of run are reported
only if a sensitive word is directly said to be them (``passphrase: ...``, ``the token is ...``): letters that follow each other
as in words (names and paths that nothing explains do), and digits alone, which never compress, be they a card or an order number.

One regular-expression pass (Arrow's, linear in the text) finds the rows worth reading; only those reach Python.

Defined results: null and empty texts have no spans (the SHA-256 of nothing); texts of any length are read whole;
repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, slim

KINDS = ("assign", "access", "hex", "novel")
NOVEL, LEAST, NEAR, AROUND, WINDOW, DRAWS = 0.9, 16, 40, 400, 64, 16
_UP, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UP, _UP.lower(), _UP + "234567", _UP.lower() + "234567",
    _UP + _DIGITS, _UP.lower() + _DIGITS, _UP + _UP.lower(), _UP + _UP.lower() + _DIGITS + "+/_=-",
)


def _either(word: str) -> str:
    """Letters in either case, spelled out: no case folding beyond A-Z."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of A-Z and 0-9 ends where the class ends, so a match of 20 or more is found by asking for it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile("|".join(map(_either, ("secret", "token", "passw", "passphrase", "credential", "bearer", "api_key", "apikey", "private_key", "access_key", "client_id"))))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SEPARATORS = re.compile(r"[+/_=-]+")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: A sensitive word that is directly said to be what follows.
BOUND = re.compile(f"(?:{SENSITIVE.pattern})[A-Za-z_]*[\"']?\\s*(?:is|:|=>?)\\s*[\"'`]?$")
#: Pairs of a letter that the letters' own shares stand for, and the bits a letter under which a run is like words.
PAIR, WORDY = 8, 4.6
WORTH = r"(?i)password|passwd|secret|token|api_?key|passw|passphrase|credential|bearer|private_key|access_key|client_id|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
IDENTIFIERS = b" ".join(
    b"""abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 authentication authorization configuration
    environment application development production connection credentials database directory repository undefined
    function return import export default public private static const string number boolean object response request
    client_secret access_token refresh_token private_key public_key secret_key api_key username password example
    placeholder your_token_here changeme index content-type application/json http https www com org null true false""".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base patterns, code points, end exclusive."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _primed(known: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=held, write_content_size=False, write_dict_id=False)


def _added(cctx: zstandard.ZstdCompressor, data: bytes) -> int:
    return len(cctx.compress(data)) - len(cctx.compress(b""))


def _known(before: str, after: str) -> bytes:
    return IDENTIFIERS + b"\n" + after.encode() + b"\n" + before.encode()


def novelty(candidate: str, before: str, after: str) -> float:
    """Bytes a character that the candidate adds when its surroundings and common identifiers are known."""
    data = candidate.encode()
    return _added(_primed(_known(before, after)), data) / len(data)


@functools.lru_cache(maxsize=4096)
def random_cost(alphabet: int, n: int) -> float:
    """The bytes that ``n`` random characters of an alphabet add when common identifiers are known: the least of fixed draws.

    (Around some lengths zstandard codes only part of the draws by entropy, so a mean would exceed many.)
    """
    draw, cctx = random.Random(n), _primed(IDENTIFIERS)
    return min(_added(cctx, "".join(draw.choices(ALPHABETS[alphabet], k=n)).encode()) for _ in range(DRAWS))


def is_novel(candidate: str, before: str, after: str) -> bool:
    """If the candidate or a window of it adds nearly what random text over its alphabet would."""
    cctx = _primed(_known(before, after))
    parts = [candidate, *(p for p in SEPARATORS.split(candidate) if LEAST <= len(p) < len(candidate))]
    if len(candidate) > WINDOW:
        parts += [candidate[at : at + WINDOW] for at in range(0, len(candidate) - WINDOW // 2, WINDOW // 2)]
    for part in parts:
        alphabet = next(k for k, a in enumerate(ALPHABETS) if set(part) <= set(a))
        if len(part) >= LEAST and _added(cctx, part.encode()) >= NOVEL * random_cost(alphabet, len(part)):
            return True
    return False


def like_words(candidate: str, before: str, after: str) -> bool:
    """If a run without digits has letters that follow each other as in the identifiers and its surroundings."""
    if re.search(r"[0-9]", candidate):
        return False
    known = re.sub(r"[^a-z]+", " ", _known(before, after).decode("utf-8", "replace").lower())
    pairs, firsts = Counter(zip(known, known[1:], strict=False)), Counter(known[:-1])
    alone = {c: (firsts[c] + 1) / (len(known) + 27) for c in " " + _UP.lower()}
    run = " " + re.sub(r"[^a-z]+", " ", candidate.lower())
    bits = sum(-math.log2((pairs[a, b] + PAIR * alone[b]) / (firsts[a] + PAIR)) for a, b in zip(run, run[1:], strict=False))
    return bits < WORDY * (len(run) - 1)


def novel_spans(text: str, taken: list[tuple[int, int, int]], near: int = NEAR) -> list[tuple[int, int, int]]:
    """Candidates with a sensitive word in or near them, outside the base spans (sorted by start), that do not compress."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    begins, ends = [w[0] for w in words], [w[1] for w in words]
    starts, reach = [b for b, _, _ in taken], list(itertools.accumulate((e for _, e, _ in taken), max))
    found = []
    for m in CANDIDATE.finditer(text) if words else ():
        at, end = m.span()
        k = bisect.bisect_left(ends, at - near)
        if k == len(words) or begins[k] > end + near:
            continue
        k = bisect.bisect_left(starts, end)
        if k and reach[k - 1] > at:
            continue
        before, after = text[max(0, at - AROUND) : at], text[end : end + AROUND]
        if (NUMBER.fullmatch(m[0]) or like_words(m[0], before, after)) and not BOUND.search(before[-2 * NEAR :]):
            continue
        if is_novel(m[0], before, after):
            found.append((at, end, 3))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


NONE = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel`` for every row; one pass, no shuffle.

    ``near``: how many characters before or behind a run a sensitive word may stand.
    """
    ddl = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worth = pc.fill_null(pc.match_substring_regex(b.column(1), WORTH), False).to_pylist()
            out = []
            for k, w in enumerate(worth):
                if not w:
                    out.append((0, 0, 0, NONE, "", 0))
                    continue
                text = b.column(1)[k].as_py()
                base = base_spans(text)
                more = novel_spans(text, base, near)
                kinds = [x[2] for x in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, joined(sorted(base + more, key=lambda x: (x[0], x[2]))), len(more)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema
            )

    return slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)
