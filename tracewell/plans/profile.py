"""The scoring profile: weights, thresholds, windows, roles. Data only; operators compile it to columns."""

from __future__ import annotations

import copy

# The default profile.
DEFAULT: dict = {
    "profile_id": "v1-verified",
    "windows_s": {"split": (180, 900), "single": (0, 3600)},
    "receivers": {"split": (3, 6), "single": (1, 1)},
    "mule": {
        "MP1": {"weight": 20, "rule": "at_least", "feature": "pass_through_share", "full": 0.90, "half": 0.60},
        "MP2": {"weight": 15, "rule": "commission", "full": {"ratio": (0.94, 0.99), "iqr": 0.02}, "half": {"ratio": (0.90, 0.99), "iqr": 0.05}},
        "MP3": {"weight": 15, "rule": "at_least", "feature": "flagged_out_share", "receive_only_feature": "flagged_in_share", "full": 0.50, "half": 0.20},
        "MP4": {"weight": 15, "rule": "at_most_of_median", "feature": "tx_count", "full": 0.30, "half": 0.50},
        "MP5": {"weight": 10, "rule": "at_least", "feature": "victim_inflow_share", "full": 0.80, "half": 0.40},
        "MP6": {"weight": 10, "rule": "any", "features": ["is_send_only", "is_receive_only"]},
        "MP7": {"weight": 10, "rule": "at_least", "feature": "neighbour_risk", "full": 60, "half": 40, "pass": 2},
        "MP8": {"weight": 5, "rule": "at_least", "feature": "amount_vs_population", "full": 20, "half": 5},
    },
    "trust": {
        "T1": {"weight": 44, "rule": "at_least", "feature": "days_active", "full": 12},
        "T2": {"weight": 0, "rule": "at_least", "feature": "reciprocity", "full": 0.30},
        "T3": {"weight": 0, "rule": "at_least", "feature": "median_hold_hours", "full": 24},
        "T4": {"weight": 19, "rule": "all", "at_least": {"amount_diversity": 0.90}, "at_most": {"amount_vs_population": 2}},
        "T5": {"weight": 32, "rule": "at_least", "feature": "neighbour_risk", "minus_from": 100, "full": 80, "pass": 2},
        "T6": {"weight": 0, "rule": "at_least", "feature": "recurring_sender_share", "full": 0.30},
        "T7": {"weight": 5, "rule": "at_least", "feature": "device_consistency", "full": 1},
    },
    "min_tx_for_trust": 5,
    "trust_discount": 0.5,
    "override": {"floor": 70, "forwarded": 0.90, "single_ratio": (0.94, 0.99), "sink_share": 0.90},
    "flag": {"threshold": 65, "signals": 2},
    "review": {"mule": 65, "trust": 60},
    "bands": {"high_confidence": 85, "suspected": 65},
    "roles": {
        "threshold": 50,
        "tie_margin": 10,
        "victim_threshold": 60,
        "commission": {"L1": (0.97, 0.99), "L2": (0.94, 0.97)},
        "L1": {"victim_inflow": 30, "split": 25, "commission": 20, "lag": 15, "flagged_out": 10},
        "L2": {"from_l1": 30, "single": 25, "commission": 20, "lag": 15, "flagged_out": 10},
        "L3": {"receive_only": 40, "from_l2": 30, "flagged_in": 20, "low_activity": 10},
        "VICTIM": {"send_only": 35, "large_outflow": 30, "payee_l1": 25, "low_activity": 10},
        "victim_max_out": 3,
        "victim_multiple": 5,
    },
    "rings": {"scatter_min": 2, "funnel_min": 3},
    "trace": {
        "max_hops": 4,
        "coverage": 0.90,
        "edge_weights": {"onward": 40, "burst": 20, "anomaly": 15, "downstream": 15, "layering": 10},
        "burst": None,
        "slot_s": 3600,
    },
}


class ProfileError(ValueError):
    """A profile that can't be scored."""


def validate(profile: dict) -> dict:
    """The profile, or ProfileError: weights not negative and summing to 100, rules known, the two-signal rule on."""
    known = {"at_least", "at_most_of_median", "commission", "any", "all"}
    for part in ("mule", "trust"):
        rules = profile[part].values()
        if any(not isinstance(r["weight"], (int, float)) or r["weight"] < 0 for r in rules):
            raise ProfileError(f"{part}: weights are numbers of at least 0")
        if abs(sum(r["weight"] for r in rules) - 100) > 1e-9:
            raise ProfileError(f"{part}: weights sum to {sum(r['weight'] for r in rules)}, not 100")
        if unknown := {r["rule"] for r in rules} - known:
            raise ProfileError(f"{part}: unknown rules {sorted(unknown)}")
    for role in ("L1", "L2", "L3", "VICTIM"):
        if sum(profile["roles"][role].values()) != 100:
            raise ProfileError(f"role {role}: weights don't sum to 100")
    if profile["flag"]["signals"] < 2:
        raise ProfileError("the two-signal rule is always on")
    if not 0 <= profile["trust_discount"] <= 1:
        raise ProfileError("trust_discount lies between 0 and 1")
    return profile


def changed(profile: dict, changes: dict) -> dict:
    """A validated copy with changes like {"mule.MP1.weight": 15}; unknown paths raise ProfileError."""
    out = copy.deepcopy(profile)
    for path, value in changes.items():
        *way, last = path.split(".")
        at = out
        for k in way:
            if not isinstance(at, dict) or k not in at:
                raise ProfileError(f"no setting {path}")
            at = at[k]
        if last not in at:
            raise ProfileError(f"no setting {path}")
        at[last] = value
    return validate(out)
