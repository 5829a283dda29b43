"""Named extension points: reward functions, reward managers, tool parsers; presets of correction settings."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.functions import graders
from rollumen.operators import policy
from rollumen.functions.chat import PARSERS  # noqa: F401  the registry of tool-call parsers

RewardManager = Callable[..., Column]
_MANAGERS: dict[str, RewardManager] = {}


def reward_manager(name: str) -> Callable[[RewardManager], RewardManager]:
    def add(f: RewardManager) -> RewardManager:
        if _MANAGERS.setdefault(name, f) is not f:
            raise ValueError(f"another reward manager is registered as {name}")
        return f

    return add


def get_reward_manager(name: str) -> RewardManager:
    if name not in _MANAGERS:
        raise ValueError(f"no reward manager {name}; there are {', '.join(sorted(_MANAGERS))}")
    return _MANAGERS[name]


def placed(score: Column, length: Column, width: int) -> Column:
    """Token rewards of a padded row: the score at the last valid token. A row of no tokens gets none."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    there = F.concat(zeros(length - 1), F.array(score.cast("double")), zeros(width - length))
    return F.when((length > 0) & (length <= width), there).otherwise(zeros(F.lit(width)))


@reward_manager("naive")
def naive(source: Column, solution: Column, gold: Column, length: Column, width: int) -> Column:
    return placed(graders.score_by_source(source, solution, gold), length, width)


@reward_manager("batch")
def batch(source: Column, solution: Column, gold: Column, length: Column, width: int) -> Column:
    return naive(source, solution, gold, length, width)


@reward_manager("dapo")
def dapo(source: Column, solution: Column, gold: Column, length: Column, width: int, longest: int = 0, buffer: int = 0, factor: float = 1.0) -> Column:
    score = graders.score_by_source(source, solution, gold)
    return placed(score + graders.overlong_penalty(length, longest, buffer, factor) if buffer else score, length, width)


@reward_manager("prime")
def prime(source: Column, solution: Column, gold: Column, length: Column, width: int) -> Column:
    """What cannot be scored counts 0: an unknown source, or a null."""
    return placed(F.coalesce(graders.score_by_source(source, solution, gold, unknown=F.lit(0.0)), F.lit(0.0)), length, width)


@reward_manager("rate_limited")
def rate_limited(source: Column, solution: Column, gold: Column, length: Column, width: int, allowed: Column | None = None) -> Column:
    """Rows that a limiter let through (streaming.queue.token_bucket) are scored; others get 0."""
    score = graders.score_by_source(source, solution, gold)
    return placed(score if allowed is None else F.when(allowed, score).otherwise(0.0), length, width)


def load(path: str, name: str) -> Callable:
    """An object of a module named by dotted name or by file."""
    if path.endswith(".py"):
        spec = importlib.util.spec_from_file_location("rollumen_custom", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(path)
    return getattr(module, name)


@dataclass(frozen=True)
class Correction:
    """Settings of importance weights (rollout_is) and rejection (rollout_rs)."""

    rollout_is: str | None = None
    is_threshold: float = 2.0
    normalise: bool = False
    rollout_rs: str | None = None
    rs_threshold: str | None = None
    bypass: bool = False
    loss: str | None = None

    def apply(self, tokens: DataFrame) -> DataFrame:
        """raw_weight, is_weight and kept_mask, with the rollout's log-probabilities as the old ones in bypass mode."""
        own = policy.bypass(tokens) if self.bypass else tokens
        return policy.rollout_correction(own, self.rollout_is, self.is_threshold, self.normalise, self.rollout_rs, self.rs_threshold)


_SUM, _GEO, _K3 = ({"rollout_rs": m, "rs_threshold": t} for m, t in (("seq_sum_k1", "0.5_2.0"), ("seq_mean_k1", "0.999_1.001"), ("seq_mean_k3", "0.01")))
_CLIP, _PG = ({"bypass": True, "loss": x} for x in ("ppo_clip", "reinforce"))
#: Presets by name.
PRESETS = {
    "decoupled_token_is": Correction("token"),
    "decoupled_seq_is": Correction("sequence"),
    "decoupled_seq_is_rs": Correction("sequence", **_SUM),
    "decoupled_geo_rs": Correction(**_GEO),
    "bypass_ppo_clip": Correction(**_CLIP),
    "bypass_ppo_clip_geo_rs": Correction(**_GEO, **_CLIP),
    "bypass_ppo_clip_k3_rs": Correction(**_K3, **_CLIP),
    "bypass_pg_is": Correction("sequence", **_PG),
    "bypass_pg_geo_rs": Correction(**_GEO, **_PG),
    "decoupled_geo_rs_seq_tis": Correction("sequence", **_GEO),
    "decoupled_geo_rs_token_tis": Correction("token", **_GEO),
    "bypass_pg_geo_rs_seq_tis": Correction("sequence", **_GEO, **_PG),
    "bypass_pg_geo_rs_token_tis": Correction("token", **_GEO, **_PG),
    "decoupled_k3_rs": Correction(**_K3),
    "decoupled_k3_rs_seq_tis": Correction("sequence", **_K3),
    "decoupled_k3_rs_token_tis": Correction("token", **_K3),
    "disabled": Correction(),
}
