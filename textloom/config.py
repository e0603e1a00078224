"""Settings of a collation: plain values, shared by every stage of a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# British and American spellings read as one.
GB_US_SPELLING = {
    "colour": "color", "honour": "honor", "favour": "favor", "neighbour": "neighbor",
    "labour": "labor", "rumour": "rumor", "grey": "gray", "theatre": "theater",
    "centre": "center", "metre": "meter", "realise": "realize", "recognise": "recognize",
    "travelling": "traveling", "travelled": "traveled", "defence": "defense", "cheque": "check",
    "harbour": "harbor", "harbours": "harbors", "colours": "colors",
    "traveller": "traveler", "travellers": "travelers",
}


@dataclass(frozen=True)
class Normalizer:
    """Which differences between word forms are folded away before comparison."""

    lowercase: bool = True
    strip_accents: bool = True
    drop_punctuation: bool = True
    split_hyphens: bool = True
    spelling: dict[str, str] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.lowercase, self.strip_accents, self.drop_punctuation, self.split_hyphens, tuple(sorted(self.spelling.items()))))


SUBSTANTIVE = Normalizer()
DIPLOMATIC = Normalizer(lowercase=False, strip_accents=False, drop_punctuation=False, split_hyphens=False)
GB_US = Normalizer(spelling=GB_US_SPELLING)
NORMALIZERS = {"substantive": SUBSTANTIVE, "diplomatic": DIPLOMATIC, "gbus": GB_US}


def normalizer(name: str | None) -> Normalizer:
    """The preset of that name, case and blanks aside; substantive for any other."""
    return NORMALIZERS.get((name or "").strip().lower(), SUBSTANTIVE)


@dataclass(frozen=True)
class Pagination:
    """Where pages begin (``markers``, every ``lines_per_page`` text lines, or at ``offsets``) and how lines count."""

    lines_per_page: int | None = None
    offsets: tuple[int, ...] | None = None
    continuous: bool = False


THROUGH_NUMBERED = Pagination(continuous=True)


@dataclass(frozen=True)
class Scores:
    match: int = 2
    mismatch: int = -1
    gap: int = -2


PROSE = Scores()
VERSE = Scores(2, -3, -1)

BASE_ANCHORED, PEER_MSA = "base-anchored", "peer-msa"
# Names under which the strategies may be asked for.
STRATEGY_NAMES = {
    "base-anchored": BASE_ANCHORED, "base": BASE_ANCHORED, "baseanchored": BASE_ANCHORED, "base_anchored": BASE_ANCHORED,
    "peer-msa": PEER_MSA, "peer": PEER_MSA, "msa": PEER_MSA, "peermsa": PEER_MSA, "peer_msa": PEER_MSA,
}


def strategy(name: str | None, has_copy_text: bool = True) -> str:
    """Parse a strategy name; without one, base-anchored for works with a copy text and peer otherwise."""
    if name is None or not name.strip():
        return BASE_ANCHORED if has_copy_text else PEER_MSA
    found = STRATEGY_NAMES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown strategy: {name}")
    return found


@dataclass(frozen=True)
class Config:
    normalizer: Normalizer = SUBSTANTIVE
    pagination: Pagination = Pagination()
    scores: Scores = PROSE
    anchor_length: int = 3
    record_accidentals: bool = False
    record_punctuation: bool = False
    strategy: str = BASE_ANCHORED


@dataclass(frozen=True)
class Limits:
    """Calibrated bounds of move detection and banded alignment (fixed values)."""

    min_anchor_length: int = 2
    bridge_gap: int = 4
    full_cells: int = 1_000_000
    initial_band: int = 64
    max_band: int = 256
    move_fraction: float = 0.03
    min_move: int = 200
    max_move: int = 6_000
    local_move: int = 80
    block_tolerance: int = 10
    free_length: int = 14
    per_token: int = 18
    confident_witness: int = 4_000
    peer_window: int = 12
    short_cells: int = 400  # cells that are aligned quicker without arrays
    held_cells: int = 64_000_000  # directions of an exact alignment in memory at a time


LIMITS = Limits()
