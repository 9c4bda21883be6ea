"""Secret scans: base patterns, and candidate strings with a window of high Shannon entropy.

DataFrame expressions only.  Positions are code points: they are sums of the lengths of matches and of what
a split at the same pattern leaves between them.  A window's characters are counted as it slides: one count
goes down, one up, and the counts are carried along, packed into a few numbers.  Time is in proportion to
the length of texts, candidates of any length among them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The base patterns with the group whose length counts, and its least length.
BASE = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
HINT = "(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}"
#: Candidates of the method: runs of these characters, at least WINDOW long, with digits and letters.
CANDIDATE, WINDOW = "[A-Za-z0-9+/_=-]{20,}", 20
#: The least entropy in bits of some window, by the characters that a candidate is made of.
CLASSES = (("^[0-9A-F-]+$", 3.2), ("^[0-9a-z]+$", 3.55), ("^[0-9A-Z]+$", 3.55), ("^[A-Za-z0-9]+$", 3.65), ("", 3.75))
# Strings that are no secrets.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|redacted|changeme|lorem",
    "(.)\\1{5}",
    "(?i)0123456789|abcdefgh|qwerty|123456789",
    # possessive repeats: what they take can't be taken otherwise, and long candidates need no deep recursion
    "^/{0,2}+(?:[A-Za-z]++[_./=+-]++)*+[A-Za-z]++[0-9]{0,4}+$",
    "^(?:/?+[A-Za-z]++[_./-])++[0-9]++(?:[_./-][A-Za-z0-9]{0,8}+)*+$",
    "^[0-9+/_=-]+$",
)

_WEIGHTS = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]
#: The characters of candidates; their counts take 5 bits each, 12 in a number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WORDS = -(-len(ALPHABET) // 12)
#: Matches whose places are summed up together.
BLOCK = 64


def spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """An array of (start, kind, end, value) of the matches of pattern that keep(match) accepts; the pattern never matches nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def walk(f: Column, b: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(s: Column, i: Column) -> Column:
            begin = s["at"] + F.get(b, i)
            end = begin + F.length(F.get(f, i))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

        def block(s: Column, i: Column) -> Column:
            own = F.aggregate(F.sequence(i, F.least(i + BLOCK, F.size(f)) - 1), F.struct(s["at"].alias("at"), none.alias("out")), step)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(s["out"], F.array(o["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(f) - 1, F.lit(BLOCK)), start, block)["out"])

    placed = let(found, lambda f: let(between, lambda b: F.zip_with(f, walk(f, b), lambda m, p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), m.alias("value")))))
    none = F.array().cast("array<struct<start:int,kind:string,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(placed, lambda s: keep(s["value"]))).otherwise(none)


def entropy(value: Column) -> Column:
    """The greatest Shannon entropy of a window of WINDOW characters of a candidate; each step takes one character out of the counts and one in."""
    weights = F.array(*[F.lit(w) for w in _WEIGHTS])
    weight = lambda n: F.get(weights, n)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    word = lambda c: F.floor(c / 12).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (5 * (c % 12)).cast("int"))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), (5 * (c % 12)).cast("int")).bitwiseAND(F.lit(31)).cast("int")
    add = lambda counts, c, sign: F.transform(counts, lambda n, k: n + F.when(k == word(c), sign * one(c)).otherwise(F.lit(0).cast("long")))
    state = lambda counts, now, least: F.struct(counts.alias("counts"), now.alias("now"), least.alias("least"))

    def slid(c: Column) -> Column:
        none = F.array(*[F.lit(0).cast("long")] * WORDS)
        grown = lambda s, i: let(F.get(c, i), lambda x: let(count(s["counts"], x), lambda n: state(add(s["counts"], x, 1), s["now"] - weight(n) + weight(n + 1), F.lit(0.0))))
        first = F.aggregate(F.sequence(F.lit(0), F.lit(WINDOW - 1)), state(none, F.lit(0.0), F.lit(0.0)), grown)

        def step(s: Column, i: Column) -> Column:
            def in_(counts: Column, now: Column, new: Column) -> Column:
                return let(count(counts, new), lambda n: let(now - weight(n) + weight(n + 1), lambda w: state(add(counts, new, 1), w, F.least(w, s["least"]))))

            def out(old: Column) -> Column:
                return let(count(s["counts"], old), lambda n: let(add(s["counts"], old, -1), lambda rest: in_(rest, s["now"] - weight(n) + weight(n - 1), F.get(c, i))))

            return let(F.get(c, i - WINDOW), out)

        steps = F.when(F.size(c) > WINDOW, F.sequence(F.lit(WINDOW), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, let(first, lambda s: state(s["counts"], s["now"], s["now"])), step)["least"]

    return F.lit(math.log2(WINDOW)) - let(codes, slid) / WINDOW


def suspicious(value: Column) -> Column:
    """Whether a candidate holds digits and letters, isn't on the allow-list, and has a window of its class's entropy."""
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(value.rlike(pattern), bits).otherwise(least)
    plain = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        plain = plain & ~value.rlike(pattern)
    return F.when(plain, entropy(value) >= least).otherwise(F.lit(False))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row.

    docs: doc_id and text; other columns are ignored.  Null text is empty, and an empty one has no spans.
    Texts and candidates of any length are scanned whole.  Spans of the method are those that touch no base
    span.  Spans that start together are listed in the order of their kinds.  Repeated rows are repeated,
    and no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:string,end:int,value:string>>")
    group = {k: (lambda v, p=p, g=g, n=n: F.length(F.regexp_extract(v, p, g)) >= n) for k, (p, g, n) in BASE.items()}
    all_spans = F.struct(*[spans(text, k, "[0-9a-f]{24,}" if k == "hex" else p, group[k]).alias(k) for k, (p, _, _) in BASE.items()], spans(text, "entropy", CANDIDATE, suspicious).alias("entropy"))
    empty = F.struct(*[none.alias(k) for k in (*BASE, "entropy")])
    found = docs.select("doc_id", F.when(text.rlike(HINT), all_spans).otherwise(empty).alias("s"))
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    ordered = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    joined = lambda a: F.array_join(F.transform(ordered(a), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.concat("s.assign", "s.access", "s.hex")
    fresh = let(base, lambda b: F.filter("s.entropy", lambda e: ~F.exists(b, lambda x: (x["start"] < e["end"]) & (e["start"] < x["end"]))))
    out = found.withColumns({"base": base, "fresh": fresh})
    counts = [F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "fresh")).alias("spans"), F.size("fresh").cast("long").alias("n_entropy"))
