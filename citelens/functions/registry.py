"""The missions: names, matching expressions and look-ups, built once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Per mission its full phrases, case-sensitive acronyms, case-insensitive acronyms, phrases that must not
# count, and ambiguous words, in registry order.
_MISSIONS: list[tuple[str, list[str], list[str], list[str], list[str], list[str]]] = [
    ("BEFS", ["Berkeley Extreme and Far UV Spectrometer", "Berkeley Extreme and Far-UV Spectrometer", "Berkeley Spectrometer"], [], ["BEFS"], [], []),
    ("COPERNICUS", ["Copernicus", "Orbiting Astronomical Observatory"], ["OAO2", "OAO3"], [], [], ["Copernicus"]),
    ("EUVE", ["Extreme Ultraviolet Explorer"], [], ["EUVE"], [], []),
    ("FIRST", [
        "Faint Images of the Radio Sky at Twenty cm", "Faint Images of the Radio Sky at Twenty-cm",
        "Faint Images of the Radio Sky at Twenty Centimeters", "Faint Images of the Radio Sky at Twenty-Centimeters",
        "Very Large Array Faint Images of the Radio Sky at Twenty Centimeters Survey",
        "Very Large Array Faint Images of the Radio Sky at Twenty-Centimeters Survey",
        "Very Large Array Faint Images of the Radio Sky at Twenty cm", "Very Large Array Faint Images of the Radio Sky at Twenty-cm",
        "Very Large Array First",
    ], ["FIRST", "VLAFIRST"], [], [], []),
    ("FUSE", ["Far Ultraviolet Spectroscopic Explorer"], ["FUSE"], [], [], []),
    ("GALEX", ["Galaxy Evolution Explorer"], [], ["GALEX"], [], []),
    ("HST", [
        "Advanced Camera for Surveys", "Cosmic Origin Spectrograph", "Goddard High Resolution", "Hubble", "Hubble Telescope",
        "Hubble Space Telescope", "Hubble Source Catalog", "Near Infrared Camera and Multi-Object Spectrometer",
        "Near-Infrared Camera and Multi-Object Spectrometer", "Near-Infrared Camera and Multi Object Spectrometer",
        "Near Infrared Camera and Multi Object Spectrometer", "Wide Field Planetary Camera", "Wide Field Planetary Camera 1",
        "Wide Field Planetary Camera 2",
    ], ["GOODS"], ["GHRS", "HST", "NICMOS", "STIS", "WFPC", "WFPC1", "WFPC2"], [], ["Hubble"]),
    ("HUT", ["Hopkins Ultraviolet Telescope"], ["HUT"], [], [], []),
    ("IMAPS", ["Interstellar Medium Absorption Profile Spectrograph"], [], ["IMAPS"], [], []),
    ("IUE", ["International Ultraviolet Explorer"], [], ["IUE"], [], []),
    ("JWST", [
        "James Webb Space Telescope", "James Webb Telescope", "Next Generation Space Telescope", "Webb Space Telescope",
        "Webb Telescope", "Near Infrared Imager and Slitless Spectrograph", "Near-Infrared Imager and Slitless Spectrograph",
        "Near Infrared Spectrograph", "Near-Infrared Spectrograph", "Mid Infrared Instrument", "Mid-Infrared Instrument",
    ], [], ["JWST", "NIRCam", "NIRSpec", "NIRISS", "MIRI", "NGST"], [], []),
    ("K2", ["Kepler K2", "K2"], [], [], [], ["K2"]),
    ("KEPLER", ["Kepler"], [], [], ["Kepler K2"], ["Kepler"]),
    ("PANSTARRS", ["Panoramic Survey Telescope and Rapid Response System"], [], ["PS1", "PanSTARS", "PanSTARR1", "PanSTARRS", "PanSTARRS1"], [], []),
    ("ROMAN", ["Roman Space Telescope", "Roman Telescope", "Wide-Field Infrared Survey Telescope", "Wide Field Infrared Survey Telescope", "Roman"], [], ["RST", "WFIRST", "NGRST"], [], ["Roman"]),
    ("TESS", ["Transiting Exoplanet Survey Satellite"], ["TESS"], [], [], []),
    ("TUES", ["Tubingen Echelle Spectrograph"], ["TUES"], [], [], []),
    ("UIT", ["Ultraviolet Imaging Telescope"], ["UIT"], [], [], []),
    ("WUPPE", ["Wisconsin Ultraviolet Photo Polarimetry Experiment", "Wisconsin Ultraviolet Photo-Polarimetry Experiment"], [], ["WUPPE"], [], []),
]


# What may stand before an acronym, between its letters and after it.
BEFORE, BETWEEN, AFTER = r"(^|[^.])", r"\.? ?-?", r"\.?($|[^A-Z|a-z])"


def _clean(acronym: str) -> str:
    return re.sub(r"[^\w]", "", acronym)


@dataclass(frozen=True)
class Mission:
    """phrases and acronyms are ordered longest first. ``name``: the shortest phrase, else the longest acronym."""

    label: str
    phrases: tuple[str, ...]
    cased: tuple[str, ...] = ()
    uncased: tuple[str, ...] = ()
    banned: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    do_not_classify: bool = False
    name: str = field(init=False)

    def __post_init__(self) -> None:
        for k in ("phrases", "cased", "uncased"):
            words = getattr(self, k) if k == "phrases" else [_clean(a) for a in getattr(self, k)]
            object.__setattr__(self, k, tuple(sorted(words, key=len, reverse=True)))
        names = [*sorted(self.phrases, key=len)[:1], *self.cased, *self.uncased]
        if not names:
            raise ValueError("a mission needs a phrase or an acronym")
        object.__setattr__(self, "name", names[0])

    def phrase_pattern(self) -> str | None:
        """Any full phrase between word boundaries; match it without regard to case."""
        return r"\b(?:" + "|".join(self.phrases) + r")\b" if self.phrases else None

    def acronym_pattern(self, cased: bool) -> str | None:
        """Any acronym, its letters possibly parted by a dot, a space and a hyphen, not after a dot and not before a letter
        or a pipe. Group 1 is the character before, group 2 the one after."""
        words = self.cased if cased else self.uncased
        if not words:
            return None
        return BEFORE + "(?:" + "|".join(r"\b" + BETWEEN.join(w) + r"\b" for w in words) + ")" + AFTER


MISSIONS = tuple(Mission(label, tuple(p), tuple(c), tuple(u), tuple(b), tuple(a)) for label, p, c, u, b, a in _MISSIONS)
LABELS = tuple(m.label for m in MISSIONS)
BY_LABEL = {m.label: m for m in MISSIONS}
