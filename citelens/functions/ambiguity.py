"""Phrases that tell whether an ambiguous word means its mission."""

# Fixed values: (mission or AnyMission, phrase with nouns in the singular, whether it means the mission), in order.
PHRASES: list[tuple[str, str, bool]] = [
    ("Copernicus", "Copernicus heliocentric", False),
    ("Copernicus", "Nicolaus Copernicus", False),
    ("Copernicus", "Copernicus velocity", False),
    ("Kepler", "Campos Kepler", False),
    ("Kepler", "Castanheira Kepler", False),
    ("Kepler", "Kepler 000", False),
    ("Kepler", "Kepler C000", False),
    ("Kepler", "Kepler type", False),
    ("Kepler", "Kepler activity", False),
    ("Kepler", "Kepler AGN", False),
    ("Kepler", "Kepler Algol", False),
    ("Kepler", "Kepler binary", False),
    ("Kepler", "Kepler cadence", True),
    ("Kepler", "Kepler CBP", False),
    ("Kepler", "Kepler census", False),
    ("Kepler", "Kepler code", False),
    ("Kepler", "Kepler dichotomy", False),
    ("Kepler", "Kepler dwarf", False),
    ("Kepler", "Kepler EB", False),
    ("Kepler", "Kepler eclipsing", False),
    ("Kepler", "Kepler exoplanet", False),
    ("Kepler", "Kepler flare", False),
    ("Kepler", "Kepler frequency", False),
    ("Kepler", "Kepler giant", False),
    ("Kepler", "Kepler host", False),
    ("Kepler", "Kepler Jupiter", True),
    ("Kepler", "Kepler Law", False),
    ("Kepler", "Kepler magnitude", False),
    ("Kepler", "Kepler main sequence", False),
    ("Kepler", "Kepler Miras", False),
    ("Kepler", "Kepler model", False),
    ("Kepler", "Kepler Neptune", False),
    ("Kepler", "Kepler Object of Interest", False),
    ("Kepler", "Kepler occurrence rate", False),
    ("Kepler", "Kepler period", False),
    ("Kepler", "Kepler planet", False),
    ("Kepler", "Kepler population", False),
    ("Kepler", "Kepler precision", True),
    ("Kepler", "Kepler progenitor", False),
    ("Kepler", "Kepler rotator", False),
    ("Kepler", "Kepler star", False),
    ("Kepler", "Kepler size", False),
    ("Kepler", "Kepler SNe", False),
    ("Kepler", "Kepler subgiant", False),
    ("Kepler", "Kepler superflare", False),
    ("Kepler", "Kepler system", False),
    ("Kepler", "Kepler transit", False),
    ("Kepler", "Kepler velocity", False),
    ("Kepler", "Koester Kepler", False),
    ("Kepler", "Romero Kepler", False),
    ("Kepler", "Winget Kepler", False),
    ("Kepler", "NASA Kepler", True),
    ("Kepler", "two Kepler", True),
    ("Kepler", "2.2 Kepler", True),
    ("Kepler", "e.g. Kepler", True),
    ("Kepler", "Kepler Input Catalog", True),
    ("Kepler", "Kepler K p", True),
    ("Kepler", "Kepler K2", False),
    ("Kepler", "Kepler LC", True),
    ("Kepler", "Kepler light", True),
    ("Kepler", "Kepler measurement", True),
    ("Kepler", "Kepler Orrery", True),
    ("Kepler", "Kepler Q1", True),
    ("Kepler", "Kepler Science Operations Center", True),
    ("Kepler", "Kepler show triplet", True),
    ("Kepler", "Kepler work", True),
    ("Kepler", "Kepler / K2", True),
    ("Kepler", "Lamost Kepler", True),
    ("Kepler", "Pre Processing Kepler", True),
    ("Kepler", "RATS Kepler", True),
    ("Kepler", "Simultaneous Kepler", True),
    ("Kepler", "whole Kepler", True),
    ("K2", "−K2 −", False),
    ("K2", "iso−K2 −", False),
    ("K2", "k2fov", False),
    ("K2", "k2phot", False),
    ("K2", "K2-000", False),
    ("K2", "K2 C000", False),
    ("K2", "K2 C0", False),
    ("K2", "K2 C3 star", False),
    ("K2", "K2 C5", False),
    ("K2", "K2 C6", False),
    ("K2", "K2 dwarf", False),
    ("K2", "K2 fit", False),
    ("K2", "K2 giant", False),
    ("K2", "K2 model", False),
    ("K2", "K2 Neptune", False),
    ("K2", "K2 precision", True),
    ("K2", "K2 star", False),
    ("K2", "K2 self", False),
    ("K2", "K2 transit", False),
    ("K2", "log g Gaia −K2", False),
    ("K2", "Order D K2", False),
    ("K2", "phot K2", False),
    ("K2", "early K2", True),
    ("K2", "EXOFOP K2", True),
    ("K2", "Gaia K2", True),
    ("K2", "Kepler K2", True),
    ("K2", "K2Gaia", True),
    ("K2", "K2GAP", True),
    ("K2", "K2 ESO", True),
    ("K2", "K2 flux", True),
    ("K2", "K2 Gaia", True),
    ("K2", "K2 Galactic Caps Project", True),
    ("K2", "K2 Hermes", True),
    ("K2", "K2 measurement", True),
    ("K2", "K2 nod", True),
    ("K2", "K2 parallax", True),
    ("K2", "K2 season", True),
    ("K2", "K2 year", True),
    ("K2", "K2 yield", True),
    ("K2", "Kepler / K2", True),
    ("Hubble", "Edwin Hubble", False),
    ("Hubble", "generalised Hubble", False),
    ("Hubble", "Hubble 000", False),
    ("Hubble", "Hubble classification", False),
    ("Hubble", "Hubble constant", False),
    ("Hubble", "Hubble horizon", False),
    ("Hubble", "Hubble law", False),
    ("Hubble", "Hubble mass", False),
    ("Hubble", "Hubble model", False),
    ("Hubble", "Hubble profile", False),
    ("Hubble", "Hubble residual", False),
    ("Hubble", "Hubble stage", False),
    ("Hubble", "Hubble value", False),
    ("Hubble", "Hubble velocity", False),
    ("Hubble", "Hubble time", False),
    ("Hubble", "t Hubble", False),
    ("Hubble", "deep Hubble", True),
    ("Hubble", "ESA / Hubble", True),
    ("Hubble", "Hubble ACS", True),
    ("Hubble", "Hubble heritage", True),
    ("Hubble", "Hubble source", True),
    ("Hubble", "Hubble system", True),
    ("Hubble", "Hubble UDF", True),
    ("AnyMission", "AnyMission candidate", False),
    ("AnyMission", "AnyMission Earth", False),
    ("AnyMission", "AnyMission et al", False),
    ("AnyMission", "AnyMission equation", False),
    ("AnyMission", "AnyMission function", False),
    ("AnyMission", "AnyMission mass", False),
    ("AnyMission", "AnyMission radius", False),
    ("AnyMission", "AnyMission team", False),
    ("AnyMission", "AnyMission analysis", True),
    ("AnyMission", "AnyMission aperture", True),
    ("AnyMission", "AnyMission archive", True),
    ("AnyMission", "AnyMission band", True),
    ("AnyMission", "AnyMission bandpass", True),
    ("AnyMission", "AnyMission based", True),
    ("AnyMission", "AnyMission baseline", True),
    ("AnyMission", "AnyMission campaign", True),
    ("AnyMission", "AnyMission catalog", True),
    ("AnyMission", "AnyMission CCD", True),
    ("AnyMission", "AnyMission curve", True),
    ("AnyMission", "AnyMission data", True),
    ("AnyMission", "AnyMission database", True),
    ("AnyMission", "AnyMission detection", True),
    ("AnyMission", "AnyMission discovery", True),
    ("AnyMission", "AnyMission documentation", True),
    ("AnyMission", "AnyMission epoch", True),
    ("AnyMission", "AnyMission field", True),
    ("AnyMission", "AnyMission filter", True),
    ("AnyMission", "AnyMission focal", True),
    ("AnyMission", "AnyMission FOV", True),
    ("AnyMission", "AnyMission image", True),
    ("AnyMission", "AnyMission imaging", True),
    ("AnyMission", "AnyMission lightcurve", True),
    ("AnyMission", "AnyMission mission", True),
    ("AnyMission", "AnyMission mode", True),
    ("AnyMission", "AnyMission model", False),
    ("AnyMission", "AnyMission monitoring", True),
    ("AnyMission", "AnyMission observation", True),
    ("AnyMission", "AnyMission observatory", True),
    ("AnyMission", "AnyMission passband", True),
    ("AnyMission", "AnyMission photometry", True),
    ("AnyMission", "AnyMission pipeline", True),
    ("AnyMission", "AnyMission pixel", True),
    ("AnyMission", "AnyMission plot", True),
    ("AnyMission", "AnyMission program", True),
    ("AnyMission", "AnyMission quarter", True),
    ("AnyMission", "AnyMission quest", True),
    ("AnyMission", "AnyMission result", True),
    ("AnyMission", "AnyMission sample", True),
    ("AnyMission", "AnyMission satellite", True),
    ("AnyMission", "AnyMission scientific", True),
    ("AnyMission", "AnyMission sensitivity", True),
    ("AnyMission", "AnyMission spacecraft", True),
    ("AnyMission", "AnyMission spectrograph", True),
    ("AnyMission", "AnyMission spectrum", True),
    ("AnyMission", "AnyMission survey", True),
    ("AnyMission", "AnyMission target", True),
    ("AnyMission", "AnyMission telescope", True),
    ("AnyMission", "AnyMission telecscope", True),
    ("AnyMission", "AnyMission theory", False),
    ("AnyMission", "AnyMission timeseries", True),
    ("AnyMission", "AnyMission treasury", True),
]
