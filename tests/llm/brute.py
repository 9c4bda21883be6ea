"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[\\x20\\x09-\\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            x = y
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(docs: dict[int, str | None], n: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id: (shingles, component)."""
    sets = {}
    for k, t in docs.items():
        w = words(ascii_lower(t or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    at, u = defaultdict(list), Union()
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    for k, s in sets.items():
        for other, both in Counter(j for x in s for j in at[x] if j < k).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                u.link(k, other)
    return {k: (len(s), u.root(k)) for k, s in sets.items()}


def later_lines(docs: dict[int, str | None], percent: int = 80, least: int = 1) -> set[tuple[int, int]]:
    seen, at, out = [], defaultdict(list), set()
    for k in sorted(docs):
        if docs[k] is None:
            continue
        for no, line in enumerate(docs[k].split("\n")):
            s = set(words(line))
            if len(s) < least:
                continue
            common = Counter(j for x in s for j in at[x])
            if any(100 * both >= percent * (len(s) + len(seen[j]) - both) for j, both in common.items()):
                out.add((k, no))
            for x in s:
                at[x].append(len(seen))
            seen.append(s)
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = {i + d for p in at.values() if len(p) > 1 for i in p for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


KINDS = {
    "assign": (re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def base_secrets(text: str | None) -> tuple[list[int], str]:
    found, counts = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        own = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(own))
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in own]
    return counts, hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()


def entropy_spans(text: str | None) -> list[tuple[int, int]]:
    """Candidates with digits and letters that aren't allowed and have a window of high entropy."""
    least = [("[0-9A-F-]+", 3.2), ("[0-9a-z]+", 3.55), ("[0-9A-Z]+", 3.55), ("[A-Za-z0-9]+", 3.65), (".*", 3.75)]
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        v = m[0]
        plain = re.search("[0-9]", v) and re.search("[A-Za-z]", v)
        plain = plain and not re.search("(?i:example|sample|dummy|placeholder|redacted|changeme|lorem|0123456789|abcdefgh|qwerty|123456789)|(.)\\1{5}", v)
        parts = re.split("[_./=+-]+", re.sub("^//?", "", v))
        words_only = all(re.fullmatch("[A-Za-z]+", p) for p in parts[:-1]) and re.fullmatch("[A-Za-z]+[0-9]{0,4}", parts[-1])
        if not plain or words_only or re.fullmatch("(?:/?[A-Za-z]+[_./-])+[0-9]+(?:[_./-][A-Za-z0-9]{0,8})*", v):
            continue
        bits = max(sum(-n / 20 * math.log2(n / 20) for n in Counter(v[i : i + 20]).values()) for i in range(len(v) - 19))
        if bits >= next(b for p, b in least if re.fullmatch(p, v)) - 1e-12:
            found.append(m.span())
    return found


def secret_spans(text: str | None) -> str:
    base = [(m.start(), rank, kind, m.end()) for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    own = [(a, 3, "entropy", b) for a, b in entropy_spans(text) if not any(x[0] < b and a < x[3] for x in base)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base + own))


def near_vectors(rows: list[tuple], cosine: float = 0.98) -> dict[int, tuple[int, int]]:
    """vec_id: (links, component); rows: vec_id, label, vector."""
    u, count, by = Union(), Counter(), defaultdict(list)
    for k, label, v in rows:
        u.root(k)
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by[label].append((k, v, math.sqrt(sum(x * x for x in v))))
    for own in by.values():
        for i, (k, v, a) in enumerate(own):
            for j, w, b in own[:i]:
                if sum(x * y for x, y in zip(v, w, strict=True)) / (a * b) >= cosine:
                    u.link(k, j)
                    count[k] += 1
                    count[j] += 1
    return {k: (count[k], u.root(k)) for k, _, _ in rows}


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def collocations(docs: list[tuple[str | None, str | None]], longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        own = counts[lang or "und" if lang is None else lang]
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", ascii_lower(text or "")):
            w = [x for x in re.split("[\\x20\\x09]+", piece) if x]
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    own[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        gone = {q for p, c in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= percent * found[q := p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def spelling_variants(docs: list[tuple[int | None, str | None]], letters: int = 7, least: int = 2, times: int = 10) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) of (doc_id, text) rows."""
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\\u00C0-\\u00FF]+", text or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)

    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and b != a and one_edit(a, b)}
    form = {}
    for w, c in n.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= times * c:
                form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])
