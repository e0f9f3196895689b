"""All tunables of the recommender in one place (every key is honoured)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # behavioural arm
    max_item_list_length: int = 50
    rating_threshold: float = 3.5
    topk_eval: int = 10
    # content arm
    embedding_dim: int = 64  # of the default text encoder
    content_top_k: int = 50
    group_profile_top_k: int = 30
    group_model_top_k: int = 100
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    # reranker
    alpha_mode: str = "dynamic"  # or "fixed": alpha_fixed for every request with a query
    alpha_fixed: float = 0.5
    alpha_min: float = 0.3
    alpha_max: float = 0.9
    home_feed_alpha: float = 0.2
    group_fairness_lambda: float = 0.5
    normalize_epsilon: float = 1e-8
    # graduation
    graduation_threshold: int = 50
    retrain_on_graduation_count: int = 100
    # user profiles / moods
    profile_decay: float = 0.95
    profile_learning_rate: float = 0.1
    profile_lr_slowdown: float = 0.01
    mood_ttl_seconds: int = 1800
    mood_blend_factor: float = 0.7
    feedback_norm_guard: float = 1e-8
    mood_history_limit: int = 10
    # execution
    broadcast_limit_bytes: int = 64 * 1024 * 1024
    search_block_bytes: int = 32 * 1024 * 1024
    search_send_bytes: int = 8 * 1024 * 1024  # of a broadcast block as it passes the driver
    search_min_block_rows: int = 64
    hot_key_rows: int = 1_000_000  # rows of one key beyond which ordered windows run as a prefix scan


DEFAULT = Config()
