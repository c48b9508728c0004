"""Every threshold of the engine in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass

# Window labels and their lengths in seconds.
USER_WINDOW = ("5min", 300)
IP_WINDOWS = (("5min", 300), ("1h", 3600), ("24h", 86400))

# The seven factor keys, in tie-breaking order.
FACTORS = (
    "token_violation",
    "request_burst",
    "token_replay",
    "response_size_burst",
    "ip_user_diversity",
    "response_sensitivity",
    "cumulative_exfil",
)

# Display labels of the factors.
FACTOR_LABELS = {
    "token_violation": "토큰규격위반",
    "request_burst": "요청수급증",
    "token_replay": "토큰재현(Replay)",
    "response_size_burst": "응답크기급증",
    "ip_user_diversity": "IP-사용자다양성",
    "response_sensitivity": "응답민감도",
    "cumulative_exfil": "누적유출량",
}

# The six baseline metrics.
BASELINE_METRICS = (
    "request_burst",
    "response_size_burst",
    "cumulative_exfil",
    "ip_user_diversity_5min",
    "ip_user_diversity_1h",
    "ip_user_diversity_24h",
)

# URI markers that always send a user to review.
SUSPICIOUS_MARKERS = (
    "/admin/", "/internal/", "/private/", "/secret/", "/system/",
    "/debug/", "/backup", "/.env", "/.git",
)


@dataclass(frozen=True)
class Config:
    # token rules
    expected_audience: str = "https://api.example"
    normal_ttl: int = 600
    long_ttl: int = 1800
    abnormal_ttl: int = 3600
    violation_cap: int = 80
    violation_samples: int = 10

    # alerting rules
    alert_long_ttl: int = 86400
    alert_stale_auth: int = 86400 * 30
    cluster_min_ips: int = 5
    cluster_samples: int = 10
    network_min_errors: int = 20
    network_error_percent: int = 10
    network_min_sensitive: int = 20
    session_min_networks: int = 3

    # baseline and scoring
    min_samples: int = 100
    exclude_score: int = 70
    alert_score: int = 50
    soft_capped_classes: tuple[str, ...] = ("cgnat_kr",)
    soft_cap: int = 30

    # review
    review_sample: int = 20
    review_max_requests: int = 200
    review_max_paths: int = 15
    review_window: int | None = None  # seconds; None = one review unit per user
    reviewer: str = "external-reviewer"

    # profiles
    keep_jtis: int = 50
    keep_sessions: int = 20
    keep_kids: int = 5
    keep_endpoints: int = 30
    keep_ips: int = 20
