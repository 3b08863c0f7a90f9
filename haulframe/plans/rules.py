"""Cleaning rules as data.

All constants that decide a cleaning result are here, so another region or a
changed regulation is a different ``CleaningRules`` value, not other code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

BOAT, SHORE, SPEAR, UNDETERMINED = "Bateau", "Bord", "Sous-marin", "Indeterminable"


@dataclass(frozen=True)
class Correction:
    """A manual correction of one catch id."""

    catch_id: int
    column: str
    value: float
    note: str


@dataclass(frozen=True)
class ModeRules:
    pattern: str
    pattern_mode: str
    subzones: tuple[tuple[int, tuple[int, ...], str], ...]  # zone, sub-zones, mode
    techniques: dict[str, str]


@dataclass(frozen=True)
class CountRules:
    """Above ``cap`` a count becomes ``cap``; what is then still above ``limit``
    becomes ``reset``, except for schooling species. ``reset <= limit < cap``."""

    zones: tuple[int, ...]
    cap: float
    limit: float
    reset: float
    exempt: tuple[str, ...]
    note: str

    def __post_init__(self):
        if not self.reset <= self.limit < self.cap:
            raise ValueError("count rules need reset <= limit < cap")


@dataclass(frozen=True)
class AnglerRules:
    """Above the boat limit of a zone, above ``limit`` or not above zero, the
    number of anglers becomes ``reset``."""

    boat_limits: tuple[tuple[int, float], ...]  # zone, most anglers aboard
    limit: float
    reset: float
    note: str


# The regional rule set.
DEFAULT_MODES = ModeRules(
    pattern="sous[- ]?marin|indienne|agachon|coulée|trou",
    pattern_mode=SPEAR,
    subzones=(
        (7, (13, 14, 15), SHORE),
        (7, (16, 17, 18, 19, 20, 21), BOAT),
        (
            4,
            (
                35, 33, 34, 39, 52, 53, 54, 55, 56, 83, 58, 59, 60, 61, 62, 63, 64, 65,
                66, 67, 68, 81, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 82, 84, 24, 25,
            ),
            BOAT,
        ),
    ),
    techniques={
        "Dérive": BOAT,
        "Broumé": UNDETERMINED,
        "Calée verticale (à l'ancre)": BOAT,
        "Lancer": UNDETERMINED,
        "Pêche du bord (rockfishing)": SHORE,
        "Surfcasting": SHORE,
        "Traine": BOAT,
        "À la palangrotte": UNDETERMINED,
    },
)
DEFAULT_COUNTS = CountRules(
    zones=(1, 7, 4, 6, 5, 8),
    cap=150,
    limit=100,
    reset=1,
    exempt=(
        "Maquereau commun", "Sardine commune", "Maquereau espagnol",
        "Maquereaux", "Girelle", "Girelle paon",
    ),
    note="Quantité de prise renseignée aberrante",
)
DEFAULT_ANGLERS = AnglerRules(
    boat_limits=((4, 12), (7, 8), (1, 12)),
    limit=30,
    reset=1,
    note="nombre de pêcheur renseigné aberrant",
)
DEFAULT_CORRECTIONS = (
    Correction(41161, "Nb_de_prises", 1, "modification nb_prise car photo montre 1 indiv"),
)


@dataclass(frozen=True)
class CleaningRules:
    date_min: str = "2025-01-01"
    invalid_zone: int = -1
    open_sea_zone: int = 8
    invalid_zone_note: str = "Zone de pêche = -1 donc on reassigne en 8"
    # label given to rows without a zone name; set it to the label in use
    default_zone_name: str = "Méditerranée (hors zone réglementée)"
    corrections: tuple[Correction, ...] = DEFAULT_CORRECTIONS
    modes: ModeRules = field(default_factory=lambda: DEFAULT_MODES)
    counts: CountRules = field(default_factory=lambda: DEFAULT_COUNTS)
    anglers: AnglerRules = field(default_factory=lambda: DEFAULT_ANGLERS)
