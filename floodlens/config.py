"""Parameters and fixed dimension values.

The detector's thresholds are parameters (``Thresholds``); the defaults are
the values the reference controller uses.  The dimension tables (watchlist,
switches, hosts, victim) are fixed values of the reference topology and are
stated plainly below.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------
# Watchlisted attacker hosts: (ip, host, switch dpid)
WATCHLIST = (
    ("10.0.0.1", "h1", 2),
    ("10.0.0.7", "h7", 3),
    ("10.0.0.13", "h13", 4),
    ("10.0.0.18", "h18", 5),
)
# Segment description pattern for a watchlisted host
SEGMENT_PATTERN = "s{dpid}-segment-attacker-{host}"
# Victim address
VICTIM_IP = "10.0.0.25"
# Switch names by dpid
SWITCHES = ((1, "s1"), (2, "s2"), (3, "s3"), (4, "s4"), (5, "s5"), (6, "s6"))
# Hosts h1..h25, five per access switch s2..s6, ip 10.0.0.N for hN
HOSTS_PER_SWITCH = 5
FIRST_ACCESS_SWITCH = 2
N_HOSTS = 25
# OpenFlow "flood" output port (exceeds a signed 32-bit int)
OFPP_FLOOD = 0xFFFFFFFB
# Detection states, event types and phases in their reporting order
DETECTION_STATES = ("NORMAL", "WARNING", "ATTACK_CONFIRMED", "DROP_ACTIVE")
PHASES = ("NORMAL", "ATTACK", "MITIGATED")
PROTOCOLS = ("ICMP", "TCP", "UDP", "ARP", "OTHER")
# Ports the capture filter keeps besides icmp/arp
CAPTURE_TCP_PORTS = (5001, 8080)
CAPTURE_UDP_PORTS = (6001,)
# Session labels accepted by the feature collector
SESSION_LABELS = ("normal", "attack")


def hosts():
    """(host, ip, dpid) for every host of the topology (derived by rule)."""
    out = []
    for n in range(1, N_HOSTS + 1):
        dpid = FIRST_ACCESS_SWITCH + (n - 1) // HOSTS_PER_SWITCH
        out.append((f"h{n}", f"10.0.0.{n}", dpid))
    return out


@dataclass(frozen=True)
class Thresholds:
    """Detector and feature parameters (defaults = reference values)."""

    window_s: float = 1.0          # trailing rate window
    warn: float = 20.0             # rate >= warn -> WARNING
    attack: float = 50.0           # rate > attack -> ATTACK_CONFIRMED (guard: >=)
    confirm_s: float = 5.0         # model-confirmed excursion length
    delay_s: float = 8.0           # alert age before mitigation
    alpha: float = 0.3             # EWMA weight
    hard_timeout_s: float = 300.0  # mitigation lifetime
    session_max_age_s: float = 300.0
    sweep_s: float = 120.0
    edge_rate: float = 5.0         # training edge cleanup

    def with_(self, **kw) -> "Thresholds":
        return replace(self, **kw)

    @property
    def window_us(self) -> int:
        return int(round(self.window_s * 1_000_000))

    @property
    def confirm_us(self) -> int:
        return int(round(self.confirm_s * 1_000_000))

    @property
    def delay_us(self) -> int:
        return int(round(self.delay_s * 1_000_000))

    @property
    def hard_timeout_us(self) -> int:
        return int(round(self.hard_timeout_s * 1_000_000))


@dataclass(frozen=True)
class Dims:
    """Dimension values; ``watchlist=None`` means every source is detected."""

    watchlist: tuple | None = WATCHLIST
    victim: str = VICTIM_IP
    switches: tuple = SWITCHES
    host_table: tuple = field(default_factory=lambda: tuple(hosts()))

    @property
    def watch_ips(self) -> list[str]:
        return [w[0] for w in self.watchlist] if self.watchlist else []


DEFAULT = Thresholds()
