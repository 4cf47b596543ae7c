"""Constants of the water-quality analytics, in one place; fixed values."""

DOYS = 366
WINDOW_DAYS = 30
MIN_SAMPLES = 5
MIN_HISTORY_DAYS = {1: 730}
MIN_HISTORY_DAYS_OTHER = 365
MAD_TO_SIGMA = 1.4826
Z_FLAG, Z_HIGH = 3.0, 5.0
SIGMA_FLOORS = {"ndti": 0.02, "ndci": 0.02, "fai": 0.005, "sediment": 0.005, "mndwi": 0.05}
DEFAULT_FLOOR = 0.01
QUALITY_INDICATORS = ("ndti", "ndci", "fai", "sediment")
CLOUD_CLASSES, NODATA_CLASSES = (3, 8, 9, 10, 11), (0, 1)
MIN_VALID_PCT, MIN_ZONE_VALID_PCT, MIN_ZONE_PIXELS = 40.0, 30.0, 25
GATE_MIN_HISTORY = 30
DEDUPE_DAYS = 14
MAX_LAG_DAYS = 5
NTU_MATCH, TSS_MATCH, CHLOROPHYLL_MATCH = 10.0, 30.0, 20.0
