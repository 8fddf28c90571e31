"""Imports every plan module so that the registry is complete."""

from . import (  # noqa: F401
    q_episodes,
    q_grid,
    q_jobs,
    q_joins,
    q_matching,
    q_ranking,
    q_rerank,
    q_sampling,
    q_search,
    q_streaming,
    q_tapes,
    q_training,
)
from .registry import PLANS

__all__ = ["PLANS"]
