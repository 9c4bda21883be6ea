"""Parameters of the barcode pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scoring:
    """Alignment scores.  Any pair with N scores 0.  A gap of length g costs gap_open + (g - 1) * gap_extend.

    mismatch is added as it stands: +1 is the published pipeline's effective value, -1 the strict one.
    """

    match: int = 2
    mismatch: int = 1
    gap_open: int = 3
    gap_extend: int = 1


@dataclass(frozen=True)
class Template:
    """An amplicon with degenerate bases (N or .): its reference, the barcode's place and length, and the usual trim."""

    full: str
    flank: int = 22

    def __post_init__(self) -> None:
        if "N" not in self.bases:
            raise ValueError("a template needs degenerate bases")

    @property
    def bases(self) -> str:
        return self.full.upper().replace(".", "N")

    @property
    def start(self) -> int:
        return self.bases.index("N")

    @property
    def stop(self) -> int:
        return self.bases.rindex("N") + 1

    @property
    def barcode_length(self) -> int:
        return self.stop - self.start

    @property
    def reference(self) -> str:
        """The barcode with its flanks."""
        return self.bases[max(0, self.start - self.flank) : self.stop + self.flank]

    def trim(self, how: str = "symmetric") -> tuple[int, int]:
        """(start, stop) of the part of a read to keep: symmetric about the barcode, none, or 'start,stop'."""
        length, after = len(self.bases), len(self.bases) - self.stop
        if how == "symmetric":
            return (self.start - after, length) if self.start > after else (0, length - (after - self.start))
        if how == "none":
            return 0, length
        start, stop = how.split(",")
        return int(start), int(stop)

    def best_score(self, scoring: Scoring) -> int:
        """The score of a perfect alignment to the reference."""
        return scoring.match * sum(c != "N" for c in self.reference)


@dataclass(frozen=True)
class Classify:
    """min_score: share of the best score; deviation: bases that a barcode's length may be off; flanks in bases to train on and to cluster with."""

    min_score: float = 0.65
    deviation: int = 4
    training_flank: int = 22
    cluster_flank: int = 22
    #: no flank before the barcode: it ends where the alignment begins
    leading: bool = False


@dataclass(frozen=True)
class Annotate:
    """flank: bases before the guide's id; id_length; indel: places that an id may be off; substitutions that it may have; barcode_length: of id and barcode where an id is off its place, else the barcode ends at the flank."""

    flank: int = 22
    id_length: int = 8
    indel: int = 1
    substitutions: int = 1
    barcode_length: int | None = None


@dataclass(frozen=True)
class Quantify:
    """The parameters of cell numbers: spike-in cells, the metric's expression, the final filter, and the fit of the GC bias."""

    spike_cells: float = 500_000.0
    metric: str = "n0 + n1"
    final_filter: str = "(concentration >= 1 and cells >= 500) or cells >= 5000"
    spike_target: str = "Spike"
    spike_share: float = 0.01
    trim: float = 0.01
    order: int = 4
    logged: bool = True


#: Targets without effect, and percentiles that reports give.
INERTS = ("Neo1", "Neo2", "Neo3", "NT1", "NT3")
PERCENTILES = (50, 60, 70, 80, 90, 95, 99)
