"""Fixed values of the catalog's data model."""

import math

# Storage sentinel of the catalog and the tolerance of the test against it.
SENTINEL = -999.0
SENTINEL_TOL = 1e-6

# Photometric bands of the multi-detection survey, with magnitude and error columns.
BANDS = ("g", "r", "i", "z", "y")
MAG_COLUMNS = tuple(f"{b}PSFMag" for b in BANDS)
ERR_COLUMNS = tuple(f"{b}PSFMagErr" for b in BANDS)
DETECTION_KEY = "original_ext_source_id"

# Colour -> temperature relations Te = A / (colour + B) * 1e4, and the colour below which they do not hold.
COLOR_TEMPERATURE = {
    "g_r_color": ("Te_gr", 1.09, 1.47),
    "r_i_color": ("Te_ri", 0.5, 0.78),
    "i_z_color": ("Te_iz", 0.38, 0.64),
}
COLOR_CUT = -0.5

# Correction of hot temperatures.
CORRECTION_THRESHOLD = 10000.0
CORRECTION_WIDTH = 2000.0

# Plausible window of an effective temperature in cross-catalog comparisons.
TEFF_MIN, TEFF_MAX = 2500.0, 40000.0

# Bin edges by target kind (left-closed reports).
TARGET_EDGES = {
    "teff": (0.0, 4000.0, 5000.0, 6000.0, 8000.0, 50000.0),
    "logg": (0.0, 2.5, 3.5, 4.5, 6.0),
    "mh": (-3.0, -1.0, -0.5, 0.5, 2.0),
}
# Labels of those bins.
TARGET_LABELS = {
    "teff": ("<4000 K (Cool)", "4000-5000 K (Solar)", "5000-6000 K", "6000-8000 K", ">8000 K (Hot)"),
    "logg": ("<2.5 dex (Giants)", "2.5-3.5 dex (Subgiants)", "3.5-4.5 dex (Dwarfs)", ">4.5 dex (High-g)"),
    "mh": ("<-1.0 dex (Metal-poor)", "-1.0 to -0.5 dex (Sub-solar)", "-0.5 to 0.5 dex (Solar)",
           ">0.5 dex (Metal-rich)"),
}
# Eight-bin report (right-closed).
EIGHT_EDGES = (0.0, 4000.0, 5000.0, 6000.0, 7000.0, 8000.0, 10000.0, 15000.0, 50000.0)
EIGHT_LABELS = ("<4k", "4–5k", "5–6k", "6–7k", "7–8k", "8–10k", "10–15k", ">15k")

# Default columns added by the extinction and the system-parameter join.
EXTINCTION_COLUMNS = ("ebv_sandf", "ebv_sfd")
EXTINCTION_RENAME = {"ebv_sfd": "ebv_sdf"}
SYSTEM_COLUMNS = ("global_ranking", "frequency", "geom_model_reference_level", "model_type")

LN10 = math.log(10.0)
LN2 = math.log(2.0)
SQRT_2PI = math.sqrt(2.0 * math.pi)

# Rational approximation of the normal tail (Hart 1968, coefficients as given by West 2005):
# 1 - cdf(z) = exp(-z^2/2) * N(z) / D(z) for z >= 0, highest power first.
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
