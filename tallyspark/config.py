"""Domain constants, passed to operators as parameters (never hard-coded in them).

FIXED VALUES: the numbers below must equal the study's for its results to
match; they are stated plainly, in the study's own order.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ForumConfig:
    # FIXED VALUES (user ids)
    staff_ids: tuple = (9, 616, 4502, 6030, 26458)
    anon_id: int = 27
    self_id: int = 5597
    spammer_id: int = 30375
    spam_date: str = "2025-08-25"
    # FIXED VALUES (pinned item ids: faq, story, changelog, guide, tos, privacy, copyright)
    perennial_item_ids: tuple = (349, 1620, 78763, 81862, 338393, 338369, 338453)
    # FIXED VALUES (data window, UTC)
    data_start: str = "2021-06-11 19:26:02.662"
    data_end: str = "2025-10-05 19:53:06.794"
    # FIXED VALUES (territory price cut-over and price tiers, sats)
    sub_cost_drop_date: str = "2024-12-24 14:44:40.812"
    sub_cost_monthly_pre: float = 100000
    sub_cost_yearly_pre: float = 1000000
    sub_cost_monthly_post: float = 50000
    sub_cost_yearly_post: float = 500000
    sub_cost_perpetual: float = 3000000
    perpetual_override_subs: tuple = ("mempool", "art")
    # FIXED VALUES (policy dates)
    sf10_date: str = "2022-11-23 19:12:15.571"
    fee10_date: str = "2023-11-12 18:39:34.742"
    sf30_date: str = "2024-09-19 21:38:43.918"
    aw_date: str = "2024-01-12 15:12:29.627"
    inv_date: str = "2024-07-01 18:31:27.924"
    nc_date: str = "2025-01-03 19:06:36.050"
    # FIXED VALUES (sample rules)
    excluded_subs: tuple = ("jobs", "ama")
    saloon_title: str = "Stacker Saloon"
    deleted_title: str = "deleted by author"
    failed_state: str = "FAILED"
    burst_gap_minutes: int = 10
    attribution_hours: int = 48
    hi_words: int = 50
    decay_half_life_days: float = 28.0
    activity_half_life_hours: float = 3.0
    internal_link_pattern: str = r"https://stacker\.news/items/(\d+)(?:[/?#][^\s]*)?"
    extra: dict = field(default_factory=dict)


DEFAULT = ForumConfig()

# FIXED VALUES: markdown image-or-link pattern (bare URL | image | link), as the study uses it.
IMG_LINK_PATTERN = r"(https?://\S+)|!\[.*?\]\(.*?\)|\[.*?\]\(.*?\)"
