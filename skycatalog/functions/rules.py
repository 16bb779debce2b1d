"""Rule tables of the catalog: plain fixed values, turned into expressions by `scalar`."""

# File extensions by format.
FITS_EXTENSIONS = ["fits", "fit", "fts"]
XISF_EXTENSIONS = ["xisf"]
RAW_EXTENSIONS = ["cr2", "cr3", "nef", "arw", "dng"]
EXTENSIONS = FITS_EXTENSIONS + XISF_EXTENSIONS + RAW_EXTENSIONS

# Image-type spellings after normalisation.
IMAGE_TYPES = {
    "LIGHT": "light", "LIGHT FRAME": "light", "LIGHTFRAME": "light",
    "DARK": "dark", "DARK FRAME": "dark", "DARKFRAME": "dark", "MASTERDARK": "dark", "MASTER DARK": "dark",
    "FLAT": "flat", "FLAT FIELD": "flat", "FLATFIELD": "flat", "MASTERFLAT": "flat", "MASTER FLAT": "flat",
    "BIAS": "bias", "BIAS FRAME": "bias", "BIASFRAME": "bias", "MASTERBIAS": "bias", "MASTER BIAS": "bias",
    "DARKFLAT": "darkflat", "DARK FLAT": "darkflat", "MASTERDARKFLAT": "darkflat", "MASTER DARK FLAT": "darkflat",
}

# Words in a path segment, tried in this order, the deepest segment first.
PATH_EDGE = (r"(^|[-_.])", r"($|[-_.])")
PATH_WORDS = [("dark[ _-]?flats?", "darkflat"), ("lights?", "light"), ("darks?", "dark"), ("flats?", "flat"), ("bias(es)?", "bias")]

# Capture programs by header keyword: (profile, keyword, 'prefix' or 'contains', text).
PROFILES = [
    ("nina", "SWCREATE", "prefix", "N.I.N.A."),
    ("sgpro", "CREATOR", "contains", "Sequence Generator Pro"),
    ("apt", "SWCREATE", "prefix", "Astro Photography Tool"),
    ("sharpcap", "SWCREATE", "prefix", "SharpCap"),
    ("asiair-asistudio", "CREATOR", "prefix", "ZWO ASI"),
    ("voyager", "SWCREATE", "prefix", "Voyager"),
]

# Numeric fields that a capture program writes under a keyword of its own: (profile, field, keyword).
FIXUPS = [("sgpro", "rotator_angle_deg", "ANGLE")]

# Record field <- FITS keywords, by the type that a keyword must have.
STRING_KEYWORDS = {
    "object": ["OBJECT"], "image_type": ["IMAGETYP"], "filter": ["FILTER"], "date_obs": ["DATE-OBS"], "telescope": ["TELESCOP"], "instrument": ["INSTRUME"],
    "observer": ["OBSERVER"], "site_name": ["SITENAME"], "pier_side": ["PIERSIDE"], "bayer_pattern": ["BAYERPAT"], "row_order": ["ROWORDER"],
}
NUMBER_KEYWORDS = {
    "exposure_seconds": ["EXPTIME", "EXPOSURE"], "ccd_temp": ["CCD-TEMP"], "gain": ["GAIN"], "offset": ["OFFSET"], "binning_x": ["XBINNING"], "binning_y": ["YBINNING"],
    "width_px": ["NAXIS1"], "height_px": ["NAXIS2"], "ra_deg": ["RA"], "dec_deg": ["DEC"], "airmass": ["AIRMASS"], "focal_length": ["FOCALLEN"], "aperture": ["APTDIA"],
    "rotator_angle_deg": ["OBJCTROT"], "set_temp": ["SET-TEMP"], "sensor_readout_hz": ["SENSORHZ"], "electrons_per_adu": ["EGAIN"],
}
# Native property that stands in for a missing keyword.
XISF_PROPERTIES = {
    "object": "Observation:Object:Name", "filter": "Instrument:Filter:Name", "telescope": "Instrument:Telescope:Name",
    "exposure_seconds": "Instrument:ExposureTime", "ccd_temp": "Instrument:Sensor:Temperature", "date_obs": "Observation:Time:Start",
}

# Canonical filters with their spellings and bands.
FILTERS = {
    "L": ("broadband", ["l", "lum", "luminance", "uv/ir", "uvir", "clear"]),
    "R": ("broadband", ["r", "red"]),
    "G": ("broadband", ["g", "green", "g2"]),
    "B": ("broadband", ["b", "blue"]),
    "Ha": ("narrowband", ["ha", "h-alpha", "halpha", "ha7nm", "ha 3nm"]),
    "OIII": ("narrowband", ["oiii", "o3", "oiii 3nm"]),
    "SII": ("narrowband", ["sii", "s2"]),
    "Dualband": ("narrowband", ["l-extreme", "l-ultimate", "nbz", "alp-t", "duo"]),
    "None": ("none", ["none"]),
}

# Catalog prefixes of object names.
CATALOG_PREFIXES = "M NGC IC SH2 LDN LBN B VDB ABELL CED RCW GUM CR MEL STOCK PGC UGC".split()

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
