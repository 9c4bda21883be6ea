"""Local alignment of many reads with one reference.

Spark dereplicates and deals out the reads; inside a task the dynamic programme runs over all reads of a
length at once, as numpy operations along the batch.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np

from ..config import Scoring

# Codes of the bases; anything else counts as N.
CODES = np.full(256, 4, np.int8)
for _code, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    CODES[list(_letters)] = _code


def matrix(scoring: Scoring, n_score: int = 0) -> np.ndarray:
    """Scores of pairs of codes."""
    m = np.full((5, 5), scoring.mismatch, np.int32)
    np.fill_diagonal(m, scoring.match)
    m[4, :] = m[:, 4] = n_score
    return m


class Letters:
    """An alphabet and the scores of its pairs; small letters count as capital ones, and what isn't in it as *, X or N, the first that is."""

    def __init__(self, letters: list[str], scores: list[list[int]]):
        self.scores = np.array(scores, np.int32)
        if self.scores.shape != (len(letters), len(letters)) or not letters:
            raise ValueError("a square matrix of the letters' scores is needed")
        other = next((letters.index(c) for c in "*XN" if c in letters), None)
        if other is None:
            raise ValueError("no letter stands for others")
        self.codes = np.full(256, other, np.int8)
        for k, c in enumerate(letters):
            self.codes[[ord(c.upper()), ord(c.lower())]] = k

    def encode(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def encode(dna: str, letters: Letters | None = None) -> np.ndarray:
    if letters is not None:
        return letters.encode(dna)
    return CODES[np.frombuffer(dna.encode("latin-1", "replace"), np.uint8)]


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


def fill(reads: np.ndarray, ref: np.ndarray, scores: np.ndarray, scoring: Scoring, room: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """H, E (gaps in the read) and F (gaps in the reference) of each read of one length; axes: place in ref, place in read, read.

    H[i, j] is the best score of an alignment that ends with ref[i - 1] and read[j - 1].  room: arrays of an
    earlier call, which are used again if they are of the right size.
    """
    n, length = reads.shape
    top = max(int(np.abs(scores).max(initial=0)), abs(scoring.gap_open), abs(scoring.gap_extend))
    kind, floor = (np.int16, -(1 << 14)) if top * (min(len(ref), length) + 2) < 1 << 13 else (np.int32, -(10**6) - 2 * top * (len(ref) + length))
    size = (len(ref) + 1, length + 1, n)
    h, e, f = room if room and room[0].shape == size and room[0].dtype == kind else (np.empty(size, kind) for _ in range(3))
    h[0], h[:, 0] = 0, 0
    for gaps in (e, f):
        gaps[0], gaps[:, 0] = floor, floor
    opening, extending = kind(scoring.gap_open), kind(scoring.gap_extend)
    own = {b: np.ascontiguousarray(scores[b].astype(kind)[reads].T) for b in set(ref.tolist())}
    base, work, one = np.empty((length, n), kind), np.empty((length, n), kind), np.empty(n, kind)
    for i in range(1, len(ref) + 1):
        np.subtract(h[i - 1, 1:], opening, out=e[i, 1:])
        if i > 1:
            np.subtract(e[i - 1, 1:], extending, out=work)
            np.maximum(e[i, 1:], work, out=e[i, 1:])
        np.add(h[i - 1, :-1], own[int(ref[i - 1])], out=base)
        np.maximum(base, e[i, 1:], out=base)
        np.maximum(base, 0, out=base)
        row, gap = h[i], f[i]
        if not length:
            continue
        np.subtract(row[0], opening, out=gap[1])
        if scoring.gap_open >= scoring.gap_extend:  # a gap after a gap is best one gap
            np.subtract(base, opening, out=work)
            for j in range(2, length + 1):
                np.subtract(gap[j - 1], extending, out=one)
                np.maximum(work[j - 2], one, out=gap[j])
            np.maximum(base, gap[1:], out=row[1:])
        else:
            np.maximum(base[0], gap[1], out=row[1])
            for j in range(2, length + 1):
                np.maximum(row[j - 1] - opening, gap[j - 1] - extending, out=gap[j])
                np.maximum(base[j - 1], gap[j], out=row[j])
    return h, e, f


def trace(h: np.ndarray, e: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray, reads: np.ndarray, ref: np.ndarray, scores: np.ndarray, scoring: Scoring, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where the alignments that end at (i, j) begin, and their operations from there: =, X, D or I a column; matches are preferred on ties.  All reads step back together.

    alike: whether each read and place shows the letter of each place of the reference; axes: place in ref, read, place in read.
    """
    i, j, n, width = i.astype(np.int64), j.astype(np.int64), h.shape[2], h.shape[1]
    flat_h, flat_e, flat_f = h.reshape(-1), e.reshape(-1), f.reshape(-1)
    state, live, steps = np.zeros(n, np.int8), np.arange(n), []
    while True:
        at = (i[live] * width + j[live]) * n + live
        free = state[live] == 0
        score = flat_h[at]
        keep = ~free | (score > 0)
        if not keep.all():
            live, at, free, score = live[keep], at[keep], free[keep], score[keep]
        if not len(live):
            break
        step = np.zeros(n, np.uint8)
        m, mi, mj = live[free], i[live[free]], j[live[free]]
        here = at[free]
        same = score[free] == flat_h[here - (width + 1) * n].astype(np.int32) + scores[ref[mi - 1], reads[m, mj - 1]]
        gone = m[~same]
        state[gone] = np.where(score[free][~same] == flat_e[here[~same]], 1, 2)
        d, x = m[same], live[state[live] > 0]
        step[d] = np.where(alike[mi[same] - 1, d, mj[same] - 1], ord("="), ord("X"))
        i[d] -= 1
        j[d] -= 1
        if len(x):
            here, deleted = (i[x] * width + j[x]) * n + x, state[x] == 1
            y, z = x[deleted], x[~deleted]  # the reference has a base that the read lacks, and the other way round
            step[y], step[z] = ord("D"), ord("I")
            ended = flat_e[here[deleted]] == flat_h[here[deleted] - width * n] - scoring.gap_open
            state[y[ended]] = 0
            i[y] -= 1
            ended = flat_f[here[~deleted]] == flat_h[here[~deleted] - n] - scoring.gap_open
            state[z[ended]] = 0
            j[z] -= 1
        steps.append(step)
    whole = np.ascontiguousarray(np.array(steps[::-1], np.uint8).reshape(len(steps), n).T)
    text, size = whole.tobytes(), len(steps)
    return i, j, [text[k * size : (k + 1) * size].lstrip(b"\0") for k in range(n)]


def cigar(runs: list[tuple[str, int]]) -> str:
    return "".join(f"{n}{op}" for op, n in runs)


#: What alignments() finds of each read.
PLACES = ("score", "score2", "ref_begin", "ref_end", "read_begin", "read_end", "ref_end2")


def alignments(reads: list[str], reference: str, scoring: Scoring = Scoring(), mask: int = 15, n_score: int = 0, cells: int = 4_000_000, letters: Letters | None = None) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The best local alignment of each read: an array for each of PLACES, and the alignments' columns (=, X, D, I)."""
    ref, scores = encode(reference, letters), matrix(scoring, n_score) if letters is None else letters.scores
    shown = _UPPER[np.frombuffer(reference.encode("latin-1", "replace"), np.uint8)]
    out = {k: np.full(len(reads), 0 if k.startswith("score") else -1, np.int32) for k in PLACES}
    paths = [b""] * len(reads)
    by_length: dict[int, list[int]] = {}
    for k, read in enumerate(reads):
        by_length.setdefault(len(read), []).append(k)
    for length, where in by_length.items():
        step, room = max(1, cells // ((len(ref) + 1) * (length + 1))), ()
        for at in range(0, len(where) if length and len(ref) else 0, step):
            few = np.array(where[at : at + step])
            text = np.frombuffer("".join([reads[k] for k in few]).encode("latin-1", "replace"), np.uint8).reshape(len(few), length)
            coded = (CODES if letters is None else letters.codes)[text]
            h, e, f = room = fill(coded, ref, scores, scoring, room)
            columns = h.max(1)
            best, ref_ends = columns.max(0), columns.argmax(0)
            hits = np.flatnonzero(best > 0)
            if not len(hits):
                continue
            every = np.arange(len(few))
            read_ends = h[ref_ends, :, every].argmax(1)
            upper = _UPPER[text]
            alike = np.stack([upper == c for c in shown])
            begin, read_begin, own = trace(h, e, f, np.where(best > 0, ref_ends, 0), np.where(best > 0, read_ends, 0), coded, ref, scores, scoring, alike)
            place = np.arange(len(ref))[:, None]
            away = np.where((place >= ref_ends - 1 - mask) & (place < ref_ends + mask), -1, columns[1:])
            second = np.where(away.max(0) > 0, away.max(0), 0) if mask >= 15 else np.zeros(len(few), np.int64)
            found = {"score": best, "score2": second, "ref_begin": begin, "ref_end": ref_ends - 1, "read_begin": read_begin, "read_end": read_ends - 1, "ref_end2": np.where(second > 0, away.argmax(0), -1)}
            for k, v in found.items():
                out[k][few[hits]] = v[hits]
            for k in hits.tolist():
                paths[few[k]] = own[k]
    return out, paths


def runs_of(path: bytes) -> str:
    """A CIGAR of an alignment's columns."""
    return "".join(f"{sum(1 for _ in same)}{chr(op)}" for op, same in groupby(path))


_PLAIN = bytes.maketrans(b"=X", b"MM")


def plain_cigars(paths: list[bytes]) -> list[str]:
    """CIGARs that don't tell matches from mismatches; like alignments are looked at once."""
    known = {p: runs_of(p.translate(_PLAIN)) for p in set(paths)}
    return [known[p] for p in paths]


def align(reads: list[str], reference: str, scoring: Scoring = Scoring(), mask: int = 15, n_score: int = 0, cells: int = 4_000_000, letters: Letters | None = None) -> list[dict]:
    """The best local alignment of each read: score, score2 (best end elsewhere, mask bases off), 0-based inclusive ends and begins, CIGAR.

    The end is the first place of the reference that reaches the score, then the first of the read.
    letters: scores by a substitution matrix in place of match and mismatch.
    """
    found, paths = alignments(reads, reference, scoring, mask, n_score, cells, letters)
    rows = zip(*[found[k].tolist() for k in PLACES], plain_cigars(paths), strict=True)
    return [dict(zip((*PLACES, "cigar"), row, strict=True)) for row in rows]


def described(reads: list[str], reference: str, scoring: Scoring = Scoring()) -> dict[str, np.ndarray | list]:
    """alignments() with the extended CIGAR, NM, the ends of the reference's run of N in the read, and the reads with their N repaired, as marked(), between_degenerate() and repaired() tell them of one read."""
    found, paths = alignments(reads, reference, scoring)
    known: dict[tuple[bytes, int], tuple[str, int, int, int]] = {}
    begins, read_begins, read_ends = (found[k].tolist() for k in ("ref_begin", "read_begin", "read_end"))
    marks, errors, starts, stops = [], [], [], []
    for read, path, begin, first, last in zip(reads, paths, begins, read_begins, read_ends, strict=True):
        if not path:
            marks.append("")
            errors.append(0)
            starts.append(-1)
            stops.append(-1)
            continue
        if (path, begin) not in known:
            of_n, j, i = [], 0, begin
            for op in path:
                if op != 73 and reference[i] == "N":
                    of_n.append((j, j + (op != 68)))
                i += op != 73  # I
                j += op != 68  # D
            known[path, begin] = (runs_of(path), len(path) - path.count(b"="), of_n[0][0] if of_n else -1, of_n[-1][1] if of_n else -1)
        text, wrong, start, stop = known[path, begin]
        after = len(read) - 1 - last
        marks.append((f"{first}S" if first else "") + text + (f"{after}S" if after else ""))
        errors.append(wrong)
        starts.append(first + start if start >= 0 else -1)
        stops.append(first + stop if start >= 0 else -1)
    masked = [k for k, read in enumerate(reads) if "N" in read and paths[k]]
    whole = list(reads)
    for k, plain in zip(masked, plain_cigars([paths[k] for k in masked]), strict=True):
        whole[k] = repaired(reads[k], reference, {"ref_begin": begins[k], "read_begin": read_begins[k], "read_end": read_ends[k], "cigar": plain})
    return found | {"cigar": marks, "nm": errors, "bc_start": starts, "bc_stop": stops, "repaired": whole}


def best_scores(reads: np.ndarray, reference: str, scoring: Scoring = Scoring(), n_score: int = 0, letters: Letters | None = None) -> np.ndarray:
    """The score of the best local alignment of each coded read of one length; axes: read, place.  letters: as in align().

    Rows of the programme are the places of the reference; only the last one is kept.
    """
    ref, scores = encode(reference, letters), matrix(scoring, n_score) if letters is None else letters.scores
    n, length = reads.shape
    by_base = {b: np.ascontiguousarray(scores[b][reads].T) for b in set(ref.tolist())}
    h, e = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -(10**6), np.int32)
    best = np.zeros(n, np.int32)
    for b in ref.tolist():
        np.maximum(h - scoring.gap_open, e - scoring.gap_extend, out=e)
        new = np.zeros_like(h)
        np.maximum(h[:-1] + by_base[b], e[1:], out=new[1:])
        np.maximum(new, 0, out=new)
        gap = np.full(n, -(10**6), np.int32)
        for j in range(1, length + 1):
            gap = np.maximum(new[j - 1] - scoring.gap_open, gap - scoring.gap_extend)
            np.maximum(new[j], gap, out=new[j])
        np.maximum(best, new.max(0), out=best)
        h = new
    return best


def parse_cigar(text: str) -> list[tuple[str, int]]:
    runs, n = [], 0
    for c in text:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            runs.append((c, n))
            n = 0
    return runs


def gapped(read: str, reference: str, found: dict) -> tuple[str, str]:
    """The aligned parts of read and reference with gaps as -."""
    i, j, a, b = found["ref_begin"], found["read_begin"], [], []
    for op, n in parse_cigar(found["cigar"]):
        a.append("-" * n if op == "D" else read[j : j + n])
        b.append("-" * n if op == "I" else reference[i : i + n])
        i += 0 if op == "I" else n
        j += 0 if op == "D" else n
    return "".join(a), "".join(b)


def marked(read: str, reference: str, found: dict) -> tuple[str, int]:
    """The extended CIGAR (=, X, soft clips) and NM, the mismatches and gap bases."""
    i, j, runs, nm = found["ref_begin"], found["read_begin"], [], 0

    def put(op: str, n: int = 1) -> None:
        if n and runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + n)
        elif n:
            runs.append((op, n))

    put("S", found["read_begin"])
    for op, n in parse_cigar(found["cigar"]):
        if op == "M":
            for d in range(n):
                same = read[j + d].upper() == reference[i + d].upper()
                nm += not same
                put("=" if same else "X")
        else:
            nm += n
            put(op, n)
        i += 0 if op == "I" else n
        j += 0 if op == "D" else n
    put("S", len(read) - 1 - found["read_end"])
    return cigar(runs), nm


def between_degenerate(read: str, reference: str, found: dict) -> tuple[int, int]:
    """Where the reference's run of N begins and ends in the read; (-1, -1) if the alignment doesn't hold both ends."""
    a, b = gapped(read, reference, found)
    first, last = b.find("N"), b.rfind("N")
    if first < 0:
        return -1, -1
    start = found["read_begin"] + sum(c != "-" for c in a[:first])
    return start, found["read_begin"] + sum(c != "-" for c in a[: last + 1])


def repaired(read: str, reference: str, found: dict) -> str:
    """The read with the N bases that lie in the alignment replaced by the reference's, gaps dropped, its ends kept."""
    a, b = gapped(read, reference, found)
    middle = "".join(y if x == "N" and y not in "-N" else x for x, y in zip(a, b, strict=True) if x != "-")
    return read[: found["read_begin"]] + middle + read[found["read_end"] + 1 :]
