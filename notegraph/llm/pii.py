"""Personal data, in DataFrame operations only: base patterns, and candidates judged by boosted trees.

Spans: a regular expression's matches come from ``regexp_extract_all`` and the gaps between them from ``split`` with the
same expression; running sums of their lengths, taken in blocks of ``STEP`` matches, are the places in code points. Patterns
that could try a long run of characters from each of its places are guarded by a look-behind, and repeats are possessive, so
that every one is linear in the text and needs no deep stack.

Base spans (``email``, ``ip``, ``card``, ``phone``) always stay. High-recall generators propose overlapping candidates: addresses
with a spelled-out, bracketed or escaped "at" and a spelled-out, bracketed or spaced "dot", addresses of hosts with such dots or
commas, other dotted numbers, digit groups with any separators, numbers without a plus. Each has format features (digits, groups, separators, Luhn, parts
above 255, top-level domain, how "at" and "dot" are written) and context features (cue words before it, what it touches).

What the trees learn is not the base rules. Rows with label 1 are confirmed base spans of the documents, in their context, but
rewritten as people disguise or shorten them (no plus, "(at)", "[.]", other separators), so that what the base rule tests is
gone, and examples made by rule (``examples``). Rows with label 0 are candidates that meet no base span, are not disguised and
have no cue before them; candidates over base spans of other kinds; and such examples. Candidates with a cue or a disguise
that meet no base span are what is to be judged and are no training rows. All different rows from the documents and all examples
take part: three quarters of them, by hash, in boosting the trees, the others, which the trees have not seen, in calibrating a
threshold per kind: the lowest at which at most ``ALLOWED`` of its label-0 rows are reported, and at most ``WRONG`` of what is reported
are such (halfway to the next lower score). So that the few examples keep their say in large tables, a label's rows from
the documents weigh ``WEIGHT`` together where there are more. Rows of equal features are one row with their weight, and there
are as many bins as keep MLlib from placing its splits by a sample (``bins``).
The trees are then a small table of splits in heap order, walked by SQL functions, and candidates at or above their kind's
threshold that meet no base span are reported. Where reported candidates overlap, directly or by way of others, only those of
one kind are added: the kind of the one that is furthest above its threshold (ties: the first kind).

A document's candidates meet its base spans in windows over its spans in order, so the work is linear in them (and a sort).

Defined results: null text is empty; no spans give an empty string and the SHA-256 of nothing; texts of any length are read
whole; repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import json
import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import cut, slim

KINDS = ("email", "ip", "card", "phone")
WEIGHT, ALLOWED, WRONG = 10_000, 0.005, 0.02
TREES, DEPTH, RATE = 12, 5, 0.5
#: Ranges of scores, within which calibration sums up row by row.
RANGES = 4096
STEP = 256
#: Characters before a candidate that its context features see; a parameter of ``detect``.
CONTEXT = 24

NAME = r"[A-Za-z0-9._%+-]"
#: Base patterns. A run of name characters is tried from its first place only, or from where the last match ended: what
#: fails there fails in the whole run, because the run must end at the @.
BASE = {
    "email": rf"(?:(?<!{NAME})|\G){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARKED = r"(?:[(\[{<]\x20?(?:[aA][tT]|@)\x20?[)\]}>]|&#64;|&commat;)"
_AT = rf"(?:\x20?@\x20?|\x20?{_MARKED}\x20?|\x20[aA][tT]\x20)"
_DOT = r"(?:\.|\x20?[(\[{<]\x20?(?:[dD][oO][tT]|\.)\x20?[)\]}>]\x20?|\x20[dD][oO][tT]\x20|\x20\.\x20)"
_LINK = r"(?:\x20?[(\[{<]\x20?(?:[dD][oO][tT]|\.)\x20?[)\]}>]\x20?|\x20[dD][oO][tT]\x20|\x20\.\x20)"
#: High-recall generators (kind, pattern), to be judged.
WIDE = (
    ("email", rf"(?:(?<!{NAME})|\G){NAME}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,5}+"),
    ("ip", rf"(?<![0-9])[0-9]++(?:{_LINK}[0-9]++){{3}}+"),
    ("ip", r"(?<![0-9])[0-9]++(?:,\x20?[0-9]++){3}+"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_-]{0,3}+[0-9]){12,18}+"),
    ("phone", r"(?<![0-9+])\+?\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){8,14}+"),
)
CUES = {
    "email": r"(?i)(?:e-?mail|\bmail|contact|write to|address|reach)[^\n]{0,14}$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|\bfrom\b|login)[^\n]{0,14}$",
    "card": r"(?i)(?:card|visa|amex|iban|account|acct|credit)[^\n]{0,14}$",
    "phone": r"(?i)(?:phone|\btel\b|\bcall\b|mobile|\bfax\b|\bcell|\bring\b|reach|\bsms\b|dial|\bfon\b|telefon|whatsapp)[^\n]{0,14}$",
}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "us", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "be", "pl", "se", "jp", "cn", "br", "ca", "au")
FEATURES = (
    "kind", "length", "digits", "letters", "separators", "groups", "longest", "first", "last", "luhn", "over", "zero", "date", "parens", "number_cue",
    "at", "dot", "bracket", "domain", "cue", "other_cue", "touches", "goes_on",
)
#: Features of numbers; for e-mail addresses they are 0, so that names like those of the table's own addresses are not learned.
NUMBERS = FEATURES[1:15]
#: Words before a number that is counted, ordered or dated, not called.
NUMBER_CUES = r"(?i)\b(?:order|invoice|isbn|ref|id|item|no|number|version|section|page|date|at|on|since|total|serial|ticket)\b[^\n]{0,6}$"
SPAN = "struct<kind:int,s:int,e:int>"


# spans --------------------------------------------------------------------------------------------------------------


def with_matches(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each ``name: (pattern, where)`` the column ``name``: array of ``(s, e, t)`` (start, end, text, in code points) of the
    leftmost non-overlapping matches in ``text``; empty where ``where`` is not true.

    The steps are projections of their own, so that no regular expression runs twice.
    """
    keep = [F.col(c) for c in rows.columns]
    text, names = F.col("text"), list(patterns)
    none = F.array().cast("array<string>")
    got = []
    for name, (pattern, where) in patterns.items():
        got += [F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"f_{name}")]
        got += [F.when(where, F.split(text, pattern, -1)).otherwise(none).alias(f"g_{name}")]
    rows = rows.select(*keep, *got)
    gap = lambda n: F.transform(F.slice(f"g_{n}", 1, F.size(f"f_{n}")), F.char_length)
    rows = rows.select(*keep, *[F.arrays_zip(F.col(f"f_{n}").alias("t"), gap(n).alias("g")).alias(f"p_{n}") for n in names])
    part = lambda n, b: F.slice(F.col(f"p_{n}"), b * STEP + 1, STEP)
    blocks = lambda n: F.sequence(F.lit(0), F.floor((F.size(f"p_{n}") - 1) / STEP).cast("int"))
    width = lambda n: F.transform(blocks(n), lambda b: F.aggregate(part(n, b), F.lit(0), lambda a, p: a + p["g"] + F.char_length(p["t"])))

    def starts(n: str) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.when(F.size(f"p_{n}") > 0, F.aggregate(width(n), first, step)["out"]).otherwise(F.array().cast("array<int>"))

    def spans(n: str) -> Column:
        def add(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["g"]
            end = start + F.char_length(p["t"])
            span = F.struct(start.alias("s"), end.alias("e"), p["t"].alias("t"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        empty = F.array().cast("array<struct<s:int,e:int,t:string>>")
        block = lambda at, b: F.aggregate(part(n, b), F.struct(at.alias("at"), empty.alias("out")), add)["out"]
        return F.flatten(F.transform(F.col(f"b_{n}"), block))

    rows = rows.select(*keep, *[F.col(f"p_{n}") for n in names], *[starts(n).alias(f"b_{n}") for n in names])
    return rows.select(*keep, *[spans(n).alias(n) for n in names])


def only_digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def passes(kind: str, t: Column) -> Column:
    n = F.char_length(only_digits(t))
    if kind == "ip":
        # numbers of more than three significant digits are over 255, and are never cast
        parts = F.transform(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.char_length(p) > 3, False).otherwise(p.cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & luhn(only_digits(t))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def candidates_of(rows: DataFrame, base: bool = True, context: int = CONTEXT) -> DataFrame:
    """``rows`` (with ``text``) without their text, with ``base`` (kind, s, e) and ``wide`` (kind, s, e, t, before, after)."""
    keep = [c for c in rows.columns if c != "text"]
    text = F.col("text")
    digit, at = text.rlike("[0-9]"), text.rlike(r"@|(?i:\bat\b)|&#64;|&commat;")
    hint = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    patterns = {f"base_{kind}": (BASE[kind], hint[kind] & F.lit(base)) for kind in KINDS}
    patterns |= {f"wide_{k}": (p, at if kind == "email" else digit) for k, (kind, p) in enumerate(WIDE)}

    def base_of(k: int, kind: str) -> Column:
        sure = F.filter(f"base_{kind}", lambda x: passes(kind, x["t"]))
        return F.transform(sure, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def wide_of(k: int, kind: str) -> Column:
        before = lambda x: F.substring(text, F.greatest(x["s"] - (context - 1), F.lit(1)), F.least(x["s"], F.lit(context)))
        after = lambda x: F.substring(text, x["e"] + 1, F.lit(2))
        number = F.lit(KINDS.index(kind))
        one = lambda x: F.struct(number.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), before(x).alias("before"), after(x).alias("after"))
        return F.transform(F.col(f"wide_{k}"), one)

    rows = with_matches(rows, patterns)
    found = [base_of(k, kind) for k, kind in enumerate(KINDS)]
    more = [wide_of(k, kind) for k, (kind, _) in enumerate(WIDE)]
    return rows.select(*keep, F.concat(*found).alias("base"), F.concat(*more).alias("wide"))


def met(found: DataFrame) -> DataFrame:
    """The candidates (row_id, kind, s, e, t, before, after) with ``meets`` (any base span) and ``covered`` (one of the kind).

    Over a document's spans in order: the furthest end of the base spans that start no later, and the nearest start behind.
    """
    some = found.where(F.size("wide") > 0)
    wide = some.select("row_id", F.explode("wide").alias("x")).select("row_id", "x.*", F.lit(False).alias("sure"))
    null = F.lit(None).cast("string")
    base = some.select("row_id", F.explode("base").alias("x")).select("row_id", "x.*", *[null.alias(c) for c in ("t", "before", "after")], F.lit(True).alias("sure"))
    up = Window.partitionBy("row_id").orderBy("s", F.desc("sure"))
    down = Window.partitionBy("row_id").orderBy(F.desc("s"), F.desc("sure"))
    kinds = [F.lit(True), *[F.col("kind") == k for k in range(len(KINDS))]]
    ends = [F.max(F.when(F.col("sure") & on, F.col("e"))).over(up).alias(f"end{j}") for j, on in enumerate(kinds)]
    nexts = [F.min(F.when(F.col("sure") & on, F.col("s"))).over(down).alias(f"next{j}") for j, on in enumerate(kinds)]
    both = wide.unionByName(base).select("*", *ends).select("*", *nexts).where("NOT sure")
    hit = lambda j: F.coalesce(F.col(f"end{j}") > F.col("s"), F.lit(False)) | F.coalesce(F.col(f"next{j}") < F.col("e"), F.lit(False))
    own = F.lit(False)
    for k in range(len(KINDS)):
        own = own | ((F.col("kind") == k) & hit(k + 1))
    return both.select("row_id", "kind", "s", "e", "t", "before", "after", hit(0).alias("meets"), own.alias("covered"))


# features and trees -------------------------------------------------------------------------------------------------


def joined(separator: Column | str, *parts: Column) -> Column:
    return F.call_function("concat_ws", F.lit(separator) if isinstance(separator, str) else separator, *parts)


def cue_of(kinds) -> Column:
    cue = F.lit(False)
    for k, kind in enumerate(KINDS):
        cue = cue | (kinds(F.col("kind"), k) & F.col("before").rlike(CUES[kind]))
    return cue


def disguised() -> Column:
    """How the candidate is written shows that it is meant to be an address: only then may it be one without a cue."""
    t = F.col("t")
    return t.rlike(rf"(?i){_LINK}") | t.rlike(_MARKED)


def featured(found: DataFrame) -> DataFrame:
    """The columns ``FEATURES`` as doubles, of rows with kind, t, before and after."""
    columns = found.columns
    t = F.col("t")
    found = found.select("*", only_digits(t).alias("__digits"), F.filter(F.split(t, r"[^0-9]+"), lambda p: p != "").alias("__parts"))
    digits, parts = F.col("__digits"), F.col("__parts")
    n, letters = F.char_length(digits), F.regexp_count(t, F.lit("[A-Za-z]"))
    sizes = F.transform(parts, F.char_length)
    over = F.exists(parts, lambda p: F.when(F.char_length(p) > 3, True).otherwise(p.cast("int") > 255))
    at = F.when(t.rlike(_MARKED), 2).when(t.contains("@"), 1).when(t.rlike(r"(?i)\x20at\x20"), 3).otherwise(0)
    dot = F.when(t.rlike(r"(?i)[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]"), 2).when(t.rlike(r"(?i)\x20(?:dot|\.)\x20"), 3).when(t.contains(","), 4).when(t.contains("."), 1).otherwise(0)
    end = F.lower(F.regexp_extract(t, r"([A-Za-z0-9-]+)\z", 1))
    values = {
        "kind": F.col("kind"), "length": F.char_length(t), "digits": n, "letters": letters, "separators": F.char_length(t) - n - letters,
        "groups": F.size(parts), "longest": F.array_max(sizes), "first": F.get(sizes, F.lit(0)), "last": F.get(sizes, F.size(sizes) - 1),
        "luhn": n.between(13, 19) & luhn(digits), "over": over, "at": at, "dot": dot, "bracket": (at == 2) | (dot == 2),
        "domain": F.when(end.isin(*DOMAINS), 2).when(end.rlike(r"\A[a-z]{2,6}\z"), 1).otherwise(0),
        "zero": digits.startswith("0"), "date": t.rlike(r"(?:19|20)[0-9]{2}[-./](?:0[1-9]|1[0-2])|[0-3][0-9][-./](?:0[1-9]|1[0-2])[-./](?:19|20)"),
        "parens": t.contains("("), "cue": cue_of(lambda a, k: a == k), "other_cue": cue_of(lambda a, k: a != k),
        "number_cue": F.col("before").rlike(NUMBER_CUES), "touches": F.col("before").rlike(r"[A-Za-z0-9.]$"),
        "goes_on": F.col("after").rlike(r"^[A-Za-z0-9]|^[.-][0-9]"),
    }
    values |= {f: F.when(F.col("kind") > 0, values[f].cast("double")) for f in NUMBERS}
    return found.select(*columns, *[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f"f_{f}") for f in FEATURES])


def rewritten() -> Column:
    """A confirmed base span as people disguise or shorten it; which way is picked by hash."""
    t, way = F.col("t"), F.pmod(F.xxhash64("t", "before"), F.lit(4))
    pick = lambda *ways: F.element_at(F.array(*[F.lit(w) for w in ways]), (way % len(ways) + 1).cast("int"))
    at = F.element_at(F.array(*[F.regexp_replace(t, r"\x20?@\x20?", w) for w in (" (at) ", "[at]", " at ", " [at] ")]), (way + 1).cast("int"))
    dots = F.element_at(F.array(*[F.regexp_replace(at, r"\.", w) for w in (".", "[.]", " dot ", " (dot) ")]), (way + 1).cast("int"))
    return (
        F.when(F.col("kind") == 0, dots)
        .when(F.col("kind") == 1, F.element_at(F.array(*[F.regexp_replace(t, r"\.", w) for w in ("[.]", " dot ", "(.)", " [dot] ")]), (way + 1).cast("int")))
        .when(F.col("kind") == 2, joined(pick(".", "/", " - ", "_"), *[F.substring(only_digits(t), a, 4) for a in (1, 5, 9)], F.substring(only_digits(t), 13, 7)))
        .otherwise(F.regexp_replace(t, r"\+", ""))
    )


def example_texts(spark: SparkSession, each: int = 150) -> DataFrame:
    """``of, label, text``: ``each`` texts a template, made by rule, with one true (1) or false (0) span of kind ``of``."""
    number = F.col("id")
    pick = lambda salt, *of: F.element_at(F.array(*[F.lit(w) for w in of]), (F.pmod(F.xxhash64(number, F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    digits = lambda n, salt: F.lpad(F.pmod(F.xxhash64(number, F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    part = lambda salt: F.pmod(F.xxhash64(number, F.lit(salt)), F.lit(256)).cast("string")
    words = ("garden", "river", "stone", "window", "little", "morning", "paper", "north", "yellow", "market", "winter", "silver")
    columns = {
        "mail": pick(1, "mail me: ", "e-mail ", "contact ", "write to ", "reach me: ", "", "", "or "),
        "call": pick(2, "call ", "phone ", "tel ", "mobile ", "fax ", "ring ", "phone: ", "call me on ", "cell "),
        "ip": pick(3, "host ", "server ", "ip ", "from ", "addr ", "login from ", "", "the "),
        "card": pick(4, "card ", "visa ", "credit card ", "account ", "amex ", "card: "),
        "plain": pick(5, "order ", "invoice ", "isbn ", "ref ", "id ", "item ", "", "", "about ", "the ", "serial ", "total ", "number "),
        "sep": pick(6, ".", "/", " - ", "_", "--", "  "),
        "at": pick(7, " (at) ", " [at] ", "(at)", "[at]", "{at}", " (AT) "),
        "dot": pick(8, ".", ".", " (dot) ", "[dot]", " dot ", "[.]"),
        "link": pick(9, "[.]", "(.)", " dot ", " (dot) ", "[dot]", " . "),
        "name": F.concat(pick(10, *words), pick(11, "", ".", "_", "-"), pick(12, "kim", "lee", "ann", "joe", "max", "eva")),
        "word": pick(13, *words), "other": pick(16, *words), "domain": pick(14, *DOMAINS[:18]), "before": pick(70, *words),
        "after": pick(71, " now", ".", ", then", " or so", "\n"), "body": digits(15, 40), "a": digits(3, 20), "b": digits(3, 21), "c": digits(4, 22),
    }
    rows = spark.range(each).select("id", *[v.alias(k) for k, v in columns.items()])
    tens = F.array(*[F.lit(str(d)) for d in range(10)])
    rows = rows.withColumn("right", F.element_at(F.filter(tens, lambda d: luhn(F.concat("body", d))), 1)).withColumn("wrong", F.element_at(F.filter(tens, lambda d: ~luhn(F.concat("body", d))), 3))
    fours = lambda d: joined(F.col("sep"), *[F.substring(F.concat("body", d), k, 4) for k in (1, 5, 9, 13)])
    rows = rows.withColumn("right", fours("right")).withColumn("fours", fours("wrong"))
    local = lambda sep: joined(sep, F.col("a"), F.col("b"), F.col("c"))
    c, t = F.col, F.lit
    templates = [
        (0, 1, [c("mail"), c("name"), c("at"), c("word"), c("dot"), c("domain")]),
        (0, 1, [c("mail"), c("name"), t(" at "), c("word"), pick(15, " dot ", " (dot) ", "[dot]"), c("domain")]),
        (0, 1, [c("mail"), c("name"), pick(72, "@", " @ "), c("word"), pick(73, " dot ", " (dot) ", "[dot]"), c("domain")]),
        (0, 0, [c("other"), pick(74, "@", " @ "), c("word"), pick(75, " . ", " dot ", " . "), pick(76, "Then", "it", "We", "she", "more", "But")]),
        (0, 0, [c("other"), t(" at "), c("word"), t("."), pick(17, *DOMAINS[:6], "Then", "It", "We", "She", "html", "But")]),
        (0, 0, [c("other"), t(" at "), digits(2, 18), t("."), digits(2, 19)]),
        (0, 0, [pick(30, "look", "stop", "points", "starts"), t(" at "), pick(31, "the", "a", "one", "every"), t(" dot "), pick(32, "matrix", "plot", "in", "of", "between")]),
        (1, 1, [c("ip"), joined(c("link"), *[part(50 + k) for k in range(4)])]),
        (1, 0, [pick(33, "version ", "section ", "v", "release ", "", "see "), joined(".", *[part(50 + k) for k in range(3)])]),
        (1, 0, [c("ip"), joined(".", *[part(50 + k) for k in range(5)])]),
        (1, 0, [pick(34, "sizes ", "scores ", "host ", ""), joined(c("link"), t("4"), digits(4, 55), part(56), digits(3, 57))]),
        (1, 0, [pick(77, "sizes ", "scores ", "host ", "card ", ""), joined(".", *[digits(4, 78 + k) for k in range(4)])]),
        (1, 0, [pick(82, "card ", "visa ", "from ", ""), joined(pick(83, ".", ","), part(50), digits(4, 84), part(51), digits(4, 85))]),
        (1, 1, [pick(86, "host ", "server ", "ip ", "login from "), joined(pick(87, ",", ", "), *[part(50 + k) for k in range(4)])]),
        (1, 0, [pick(88, "sizes ", "scores ", "", "total ", "rows ", "the "), joined(pick(89, ",", ", "), *[part(50 + k) for k in range(4)])]),
        (2, 1, [c("card"), c("right")]),
        (2, 0, [c("card"), c("fours")]),
        (2, 0, [c("plain"), c("fours")]),
        (2, 0, [c("plain"), joined(pick(35, ".", "/", " ", "  ", "-"), *[digits(2, 60 + k) for k in range(8)])]),
        (2, 0, [c("plain"), c("body"), c("wrong")]),
        (3, 1, [c("call"), t("("), c("a"), t(") "), c("b"), t("-"), c("c")]),
        (3, 1, [c("call"), local(pick(36, "-", ".", " "))]),
        (3, 1, [c("call"), t("0"), pick(37, "", "0"), digits(2, 23), pick(38, " ", "-", "/"), c("a"), pick(39, "", " ", "-"), c("c")]),
        (3, 1, [pick(41, "", "or ", "and ", "under "), t("("), c("a"), t(") "), c("b"), t("-"), c("c")]),
        (3, 0, [c("plain"), digits(10, 26)]),
        (3, 0, [c("plain"), digits(12, 27)]),
        (3, 0, [c("plain"), local(pick(42, "-", ".", " "))]),
        (3, 0, [pick(43, "on ", "at ", "", "since ", "date "), t("20"), digits(2, 28), t("-0"), pick(44, "1", "4", "9"), t("-1"), digits(1, 29), t(" "), digits(2, 45)]),
        (3, 0, [c("plain"), t("978-"), digits(1, 46), t("-"), digits(2, 47), t("-"), digits(6, 48), t("-"), digits(1, 49)]),
        (3, 0, [c("plain"), joined(pick(51, " ", "."), digits(2, 61), digits(3, 62), digits(3, 63), digits(3, 64))]),
        (3, 0, [c("plain"), joined("/", digits(4, 65), digits(4, 66), digits(3, 67))]),
    ]
    texts = [F.struct(t(k).alias("of"), t(y).alias("label"), F.concat("before", t(" "), *parts, "after").alias("text")) for k, y, parts in templates]
    return cut(rows.select(F.explode(F.array(*texts)).alias("x")).select("x.*"), "pii-texts")


def examples(spark: SparkSession) -> DataFrame:
    """``kind, t, before, after, label``: the texts made by rule, met by the generators like any text."""
    found = cut(candidates_of(example_texts(spark), base=False), "pii-examples")  # else the planner pastes the steps together
    wide = found.select("of", "label", F.explode("wide").alias("x"))
    return wide.where("x.kind = of").select("x.kind", "x.t", "x.before", "x.after", "label").distinct()


def heap(node, at: int, splits: list, leaves: list, depth: int = 0) -> None:
    """Write a fitted tree (a JVM node) in heap order, filled up to ``DEPTH``: below an early leaf all leaves are that one."""
    if depth == DEPTH:
        leaves[at - (2**DEPTH - 1)] = float(node.prediction())
        return
    inner = node.numDescendants() > 0
    if inner:
        splits[at] = {"f": node.split().featureIndex(), "t": float(node.split().threshold())}
    for side in (0, 1):
        below = (node.rightChild() if side else node.leftChild()) if inner else node
        heap(below, 2 * at + 1 + side, splits, leaves, depth + 1)


def margin_of(model) -> Column:
    """The trees' weighted sum. They are one constant array; a row walks each tree by ``DEPTH`` steps, so that the plan does not
    grow with the trees."""
    table = []
    for tree, w in zip(model._java_obj.trees(), model.treeWeights, strict=True):
        splits, leaves = [{"f": 0, "t": 0.0}] * (2**DEPTH - 1), [0.0] * 2**DEPTH
        heap(tree.rootNode(), 0, splits, leaves)
        table.append({"s": splits, "v": leaves, "w": w})
    trees = F.from_json(F.lit(json.dumps(table)), "array<struct<s:array<struct<f:int,t:double>>,v:array<double>,w:double>>")
    row = F.array(*[F.col(f"f_{f}") for f in FEATURES])

    def walk(tree: Column, values: Column) -> Column:
        def down(at: Column, _) -> Column:
            split = F.get(tree["s"], at)
            return 2 * at + F.when(F.get(values, split["f"]) <= split["t"], 1).otherwise(2)

        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down) - (2**DEPTH - 1)

    return F.aggregate(trees, F.lit(0.0), lambda sum_, tree: sum_ + F.get(tree["v"], walk(tree, row)) * tree["w"])


@dataclasses.dataclass
class Trees:
    margin: Column
    thresholds: dict[int, float]

    def excess(self) -> Column:
        """How far a featured candidate is above its kind's threshold."""
        least = F.lit(float("inf"))
        for k, v in self.thresholds.items():
            least = F.when(F.col("kind") == k, F.lit(v)).otherwise(least)
        return self.margin - least

    def reported(self) -> Column:
        return self.excess() >= 0


def one_kind(reported: DataFrame) -> DataFrame:
    """Of rows (row_id, kind, s, e, excess), those of the best kind in each run of spans that overlap; linear after a sort."""
    order = Window.partitionBy("row_id").orderBy("s", "e", "kind")
    ends = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = reported.withColumn("new", F.coalesce(ends <= F.col("s"), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by("kind", F.struct("excess", -F.col("kind"))).over(Window.partitionBy("row_id", "run"))
    return rows.withColumn("best", best).where("kind = best").select("row_id", "kind", "s", "e")


def training_rows(candidates: DataFrame) -> DataFrame:
    """``kind, t, before, after, label, made, h``, features: every different row from the documents, and the examples (``made``)."""
    sure = candidates.where("covered").withColumn("t", rewritten()).withColumn("label", F.lit(1))
    unlike = F.col("meets") | ~(cue_of(lambda a, k: a == k) | disguised())
    other = candidates.where(~F.col("covered") & unlike).withColumn("label", F.lit(0))
    columns = ["kind", "t", "before", "after", "label"]
    rows = examples(candidates.sparkSession).withColumn("made", F.lit(True))
    for of in (sure, other):
        one = of.groupBy("kind", "t", "before", "label").agg(F.min("after").alias("after")).select(*columns, F.lit(False).alias("made"))
        rows = rows.unionByName(one)
    return cut(featured(rows).withColumn("h", F.xxhash64("kind", "t", "before")), "pii-training")


def bins(n: int) -> int:
    """MLlib finds its splits on all ``n`` rows if they are no more than 10,000 or the square of its bins, else on a sample."""
    return 32 if n <= 10_000 else math.isqrt(n - 1) + 1


def calibrated(scored: DataFrame, weights: dict[int, float]) -> dict[int, float]:
    """A threshold per kind, from (kind, m, label, made, docs): score, label, and how many examples and rows from documents.

    Going down the scores, sums are those of the higher ranges of scores and, within a range, of the higher rows, so no task holds a kind.
    """
    names = [f"{of}{y}" for y in (0, 1) for of in ("made", "docs")]
    sums = [F.sum(F.when(F.col("label") == y, F.col(of)).otherwise(0)).alias(f"{of}{y}") for y in (0, 1) for of in ("made", "docs")]
    rows = cut(scored.groupBy("kind", "m").agg(*sums), "pii-scores")
    low, high = rows.agg(F.min("m"), F.max("m")).first()
    width = (high - low) / RANGES if low is not None and low < high else 1.0
    rows = rows.withColumn("range", F.floor((F.col("m") - F.lit(low)) / F.lit(width)))
    above = Window.partitionBy("kind").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows a kind
    ranges = rows.groupBy("kind", "range").agg(*[F.sum(c).alias(c) for c in names])
    whole = [F.sum(c).over(Window.partitionBy("kind")).alias(f"all_{c}") for c in names]
    ranges = ranges.select("kind", "range", *whole, *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in names])
    down = Window.partitionBy("kind", "range").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(ranges), ["kind", "range"])
    rows = rows.select("kind", "m", (F.col("made1") + F.col("docs1") > 0).alias("right"), *[F.col(f"all_{c}") for c in names], *[(F.sum(c).over(down) + F.col(f"above_{c}")).alias(c) for c in names])
    weight = lambda y, of="": F.col(f"{of}made{y}") + F.lit(weights[y]) * F.col(f"{of}docs{y}")
    good = F.col("right") & (weight(0) <= ALLOWED * weight(0, "all_")) & (weight(0) <= WRONG * (weight(0) + weight(1)))
    rows = cut(rows.select("kind", "m", good.alias("good")), "pii-calibration")
    best = rows.where("good").groupBy("kind").agg(F.min("m").alias("best"))
    nexts = rows.join(F.broadcast(best), "kind").groupBy("kind", "best").agg(F.max(F.when(F.col("m") < F.col("best"), F.col("m"))).alias("after"))
    found = {r["kind"]: (r["best"] + (r["best"] if r["after"] is None else r["after"])) / 2 for r in nexts.collect()}  # at most a row a kind
    return {k: found.get(k, float("inf")) for k in range(len(KINDS))}


def fit(candidates: DataFrame) -> Trees:
    """Boost on three quarters of the training rows and calibrate a threshold per kind on the others."""
    rows = training_rows(candidates)
    found = {r["label"]: r["n"] for r in rows.where("NOT made").groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = {y: min(1.0, WEIGHT / found.get(y, 1)) for y in (0, 1)}
    features = [f"f_{f}" for f in FEATURES]
    number = lambda of: F.sum(of.cast("long"))
    rows = rows.groupBy((F.col("h") % 4 == 0).alias("held"), "kind", "label", *features).agg(number(F.col("made")).alias("made"), number(~F.col("made")).alias("docs"))
    rows = cut(rows, "pii-vectors")
    learn, tune = rows.where("NOT held"), rows.where("held")
    vec = array_to_vector(F.array(*features)).alias("features")
    weight = F.col("made") + F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])) * F.col("docs")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=3, maxBins=bins(learn.count()), weightCol="weight")
    margin = margin_of(trees.fit(learn.select(vec, F.col("label").cast("double"), weight.alias("weight"))))
    return Trees(margin, calibrated(tune.select("kind", "label", "made", "docs", margin.alias("m")), weights))


def detect(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row."""
    rows = slim(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    found = cut(candidates_of(rows, context=context), "spans")
    proposed = cut(met(found), "candidates")
    trees = fit(proposed)
    more = featured(proposed.where("NOT meets")).where(trees.reported()).select("row_id", "kind", "s", "e", trees.excess().alias("excess"))
    more = one_kind(more).groupBy("row_id").agg(F.collect_set(F.struct("kind", "s", "e")).alias("added"))
    found = found.join(more, "row_id", "left")
    added = F.coalesce(F.col("added"), F.array().cast(f"array<{SPAN}>"))
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))
    text = lambda xs: F.array_join(F.transform(F.array_sort(xs), one), ",")
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.concat("base", added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
    )


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(docs)
