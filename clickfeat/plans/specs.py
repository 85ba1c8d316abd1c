"""Feature catalogue: name, kind, key set and aggregated column."""

from __future__ import annotations

from dataclasses import dataclass

AGGREGATE_KINDS = ("count", "count_nonnull", "nunique", "mean", "var", "skew")
SEQUENCE_KINDS = ("cumcount", "next", "prev", "next_epoch")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    keys: tuple[str, ...]
    value: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in AGGREGATE_KINDS + SEQUENCE_KINDS:
            raise ValueError(f"unknown feature kind {self.kind!r}")


def _specs(kind: str, rows: str) -> list[FeatureSpec]:
    """Lines of ``name: keys [-> value]``."""
    out = []
    for line in rows.strip().splitlines():
        name, rest = (part.strip() for part in line.split(":"))
        keys, _, value = (part.strip() for part in rest.partition("->"))
        out.append(FeatureSpec(name, kind, tuple(keys.split()), value or None))
    return out


# Feature names, their keys and aggregated columns.  Some names
# say something else than the keys do; downstream column lists rely on them.
CATALOGUE: list[FeatureSpec] = [
    *_specs(
        "cumcount",
        """
        ip_d_os_c_app: ip device os -> app
        ip_c_os: ip -> os
        """,
    ),
    *_specs(
        "nunique",
        """
        ip_cu_c: ip -> channel
        ip_da_cu_h: ip day -> hour
        ip_cu_app: ip -> app
        ip_app_cu_os: ip app -> os
        ip_cu_d: ip -> device
        app_cu_chl: app -> channel
        ip_d_os_cu_app: ip device os -> app
        """,
    ),
    *_specs(
        "count",
        """
        ip_da_co: ip day
        ip_app_co: ip app
        ip_app_os_co: ip app os
        ip_d_co: ip device
        app_chl_co: app channel
        ip_ch_co: ip channel
        ip_app_chl_co: ip app channel
        app_d_co: app device
        app_os_co: app os
        ip_os_co: ip os
        ip_d_os_co: ip device os app
        ip_app_h_co: ip app hour
        ip_app_os_h_co: ip app os hour
        ip_d_h_co: ip device hour
        app_chl_h_co: app channel hour
        ip_ch_h_co: ip channel hour
        ip_app_chl_h_co: ip app channel hour
        app_d_h_co: app device hour
        app_os_h_co: app os hour
        ip_os_h_co: ip os hour
        ip_d_os_h_co: ip device os app hour
        """,
    ),
    *_specs(
        "var",
        """
        ip_da_chl_var_h: ip day channel -> hour
        ip_chl_var_h: ip channel -> hour
        ip_app_os_var_h: ip app os -> hour
        ip_app_chl_var_da: ip app channel -> day
        ip_app_chl_var_h: ip app -> hour
        app_os_var_da: app os -> hour
        app_d_var_h: app device -> hour
        app_chl_var_h: app channel -> hour
        """,
    ),
    *_specs(
        "mean",
        """
        ip_app_chl_mean_h: ip app channel -> hour
        ip_chl_mean_h: ip channel -> hour
        ip_app_os_mean_h: ip app os -> hour
        ip_app_mean_h: ip app -> hour
        app_os_mean_h: app os -> hour
        app_mean_var_h: app device -> hour
        app_chl_mean_h: app channel -> hour
        """,
    ),
    *_specs(
        "prev",
        """
        ip_channel_prevClick: ip channel
        ip_os_prevClick: ip os
        ip_app_device_os_channel_prevClick: ip app device os channel
        ip_os_device_prevClick: ip os device
        ip_os_device_app_prevClick: ip os device app
        """,
    ),
    *_specs(
        "next",
        """
        ip_app_device_os_channel_nextClick: ip app device os channel
        ip_os_device_nextClick: ip os device
        ip_os_device_app_nextClick: ip os device app
        device_nextClick: device
        device_channel_nextClick: device channel
        app_device_channel_nextClick: app device channel
        device_hour_nextClick: device hour
        """,
    ),
]

_BY_NAME = {spec.name: spec for spec in CATALOGUE}


def pick(*names: str) -> list[FeatureSpec]:
    return [_BY_NAME[name] for name in names]


# The features kept in the final data.
FINAL_FEATURES: list[FeatureSpec] = pick(
    *"""
    ip_d_os_c_app ip_cu_c ip_da_cu_h ip_cu_app ip_app_cu_os ip_cu_d ip_d_os_cu_app
    ip_da_co ip_app_co ip_d_co app_chl_co ip_ch_co app_d_co ip_os_co ip_d_os_co
    ip_app_h_co ip_app_os_h_co ip_d_h_co app_chl_h_co ip_ch_h_co app_d_h_co app_os_h_co
    ip_os_h_co ip_d_os_h_co ip_da_chl_var_h ip_chl_var_h ip_app_os_var_h ip_app_chl_var_da
    ip_app_chl_var_h app_chl_var_h ip_app_os_mean_h app_os_mean_h
    ip_channel_prevClick ip_app_device_os_channel_prevClick ip_os_device_app_prevClick
    ip_app_device_os_channel_nextClick ip_os_device_nextClick ip_os_device_app_nextClick
    """.split()
)

def numbered(prefix: str = "X") -> list[FeatureSpec]:
    """The numbered features 0..8; they are used under the prefixes X and XX."""
    # Kind, keys and aggregated column by number.
    rows = [
        ("nunique", ("ip",), "channel"),
        ("cumcount", ("ip", "device", "os"), "app"),
        ("nunique", ("ip", "day"), "hour"),
        ("nunique", ("ip",), "app"),
        ("nunique", ("ip", "app"), "os"),
        ("nunique", ("ip",), "device"),
        ("nunique", ("app",), "channel"),
        ("cumcount", ("ip",), "os"),
        ("nunique", ("ip", "device", "os"), "app"),
    ]
    return [FeatureSpec(f"{prefix}{i}", *row) for i, row in enumerate(rows)]


# The features kept beside the numbered ones.
NUMBERED_FEATURES: list[FeatureSpec] = [
    *numbered(),
    FeatureSpec("ip_tcount", "count_nonnull", ("ip", "day", "hour"), "channel"),
    FeatureSpec("ip_app_count", "count_nonnull", ("ip", "app"), "channel"),
    FeatureSpec("ip_app_os_count", "count_nonnull", ("ip", "app", "os"), "channel"),
    FeatureSpec("ip_tchan_count", "var", ("ip", "day", "channel"), "hour"),
    FeatureSpec("ip_app_os_var", "var", ("ip", "app", "os"), "hour"),
    FeatureSpec("ip_app_channel_var_day", "var", ("ip", "app", "channel"), "day"),
    FeatureSpec("ip_app_channel_mean_hour", "mean", ("ip", "app", "channel"), "hour"),
]

# Key sets of the chunk features; each count is named ``<keys>_count``.
CHUNK_COUNT_KEYS: tuple[tuple[str, ...], ...] = (
    ("ip", "day", "hour"),
    ("ip", "app"),
    ("ip", "app", "os"),
    ("ip", "device"),
    ("app", "channel"),
    ("ip", "app", "hour"),
    ("ip", "app", "os", "hour"),
    ("ip", "device", "hour"),
    ("app", "channel", "hour"),
    ("ip", "app", "channel"),
    ("ip", "app", "channel", "hour"),
)
CHUNK_FEATURES: list[FeatureSpec] = [
    FeatureSpec(f"{'_'.join(keys)}_count", "count", keys) for keys in CHUNK_COUNT_KEYS
] + [FeatureSpec("next_click", "next_epoch", ("ip", "app", "device", "os"))]

# Kind of each numeric code 0..5.
KIND_BY_CODE = ("count_nonnull", "mean", "var", "skew", "nunique", "cumcount")


def spec_by_code(name: str, columns: list[str] | tuple[str, ...], code: int) -> FeatureSpec:
    """Spec from a column list whose last entry is the aggregated column, and a kind code."""
    return FeatureSpec(name, KIND_BY_CODE[code], tuple(columns[:-1]), columns[-1])
