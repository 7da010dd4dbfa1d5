"""Parameters of the registered queries over the driver's tables.

The driver's ``events`` are far slower than a flood (trailing counts <= 6
at sf0.01), so the registered queries run the detector with scaled
thresholds; the library defaults stay those of the reference (20/50/5/8/300).
"""

from floodlens.config import Dims, Thresholds

# Fixed query parameters for the registered queries (one setting for every sf)
FIXTURE_TH = Thresholds(warn=1.5, attack=2.5, confirm_s=2.0, delay_s=3.0, hard_timeout_s=10.0)
ENTRY_TH = Thresholds(warn=0.5, attack=1.0, confirm_s=2.0, delay_s=1.0, hard_timeout_s=10.0)
# Detect every source (the adapter's hosts are not the reference attackers)
ALL_SOURCES = Dims(watchlist=None)
# Watchlist of the registered queries: in the packet view the reference's four
# attackers never reach the scaled thresholds, so the fixture watches four
# hosts that do (h6, h10, h16, h21) and one that does not (h1).
FIXTURE_WATCHLIST = (
    ("10.0.0.1", "h1", 2),
    ("10.0.0.6", "h6", 3),
    ("10.0.0.10", "h10", 3),
    ("10.0.0.16", "h16", 5),
    ("10.0.0.21", "h21", 6),
)
WATCHED = Dims(watchlist=FIXTURE_WATCHLIST)
CHUNK_S = 10.0
