"""Validated settings of a co-training run."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from peerlabel.functions.voting import MINMAX, SUM

DEFAULT_THRESHOLD = 0.75


def subspace_size(n_features: int, given: int = 0, rule: str = "ceil") -> int:
    """Features each member may use; ``given`` wins when positive."""
    if given > 0:
        return given
    if n_features < 1:
        raise ValueError("n_features must be at least 1")
    if rule == "ceil":
        return math.ceil(math.log(n_features) / math.log(2) + 1)
    if rule == "floor":
        return int(math.log(n_features + 1) / math.log(2)) + 1
    raise ValueError(f"unknown subspace rule {rule!r}")


@dataclass(frozen=True)
class CoTrainConfig:
    """Options of :func:`peerlabel.plans.cotrain.cotrain`.

    ``threshold`` 0 means 0.75. ``n_members`` 0 means "as many as were passed".
    ``init_s_prime`` None means ``min(|U| / 10, 100)``.

    ``weight_col`` names a column of weights that labelled and unlabelled rows have. Then an
    exact bootstrap draws by weight, and Poisson bags keep their counts, each draw weighing its
    row's weight; errors are shares of weight; |U| and the draws from it are weights too.
    """

    n_classes: int
    n_members: int = 0
    n_features: int = 0
    features_per_member: int = 0
    subspace_rule: str = "ceil"
    threshold: float = 0.0
    max_rounds: int = 100
    init_s_prime: float | None = 100.0
    normaliser: str = MINMAX
    subsample: str = "bernoulli"
    bootstrap: str = "poisson"
    retrain_weights: bool = False
    seed: int = 1
    parallelism: int = 4
    persist_inputs: bool = False
    weight_col: str | None = None

    def __post_init__(self):
        if self.threshold == 0:
            object.__setattr__(self, "threshold", DEFAULT_THRESHOLD)
        if self.n_classes < 2:
            raise ValueError("n_classes must be at least 2")
        if self.n_members == 1 or self.n_members < 0:
            raise ValueError("n_members must be at least 2: members are judged by the others")
        if self.threshold < 0:
            raise ValueError("threshold must not be negative")
        if self.max_rounds < 1:
            raise ValueError("max_rounds must be at least 1")
        if self.init_s_prime is not None and self.init_s_prime <= 0:
            raise ValueError("init_s_prime must be positive")
        if self.parallelism < 1:
            raise ValueError("parallelism must be at least 1")
        _one_of("normaliser", self.normaliser, (MINMAX, SUM))
        _one_of("subsample", self.subsample, ("bernoulli", "exact"))
        _one_of("bootstrap", self.bootstrap, ("poisson", "exact", "block"))
        if self.bootstrap == "block" and self.weight_col is not None:
            raise ValueError("the block bootstrap knows no weights")
        _one_of("subspace_rule", self.subspace_rule, ("ceil", "floor"))

    @classmethod
    def preset(cls, name: str, n_classes: int, **options) -> CoTrainConfig:
        """``spark`` (Poisson bags, min-max votes) or ``paper`` (exact draws, sum votes)."""
        _one_of("preset", name, ("spark", "paper"))
        base = {}
        if name == "paper":
            base = dict(
                normaliser=SUM,
                subsample="exact",
                bootstrap="exact",
                retrain_weights=True,
                init_s_prime=None,
                subspace_rule="floor",
            )
        return cls(n_classes=n_classes, **{**base, **options})

    def for_members(self, n_given: int) -> CoTrainConfig:
        """The same settings with the number of members filled in and checked."""
        if self.n_members not in (0, n_given):
            raise ValueError(f"n_members is {self.n_members} but {n_given} members were passed")
        if n_given < 2:
            raise ValueError("at least 2 members are needed")
        return replace(self, n_members=n_given)

    def starting_weight(self, n_unlabelled: float) -> float:
        if self.init_s_prime is not None:
            return float(self.init_s_prime)
        return float(min(n_unlabelled / 10, 100.0))

    def features_each(self) -> int:
        """Features a member may use, from ``n_features`` and the preset's rule."""
        return subspace_size(self.n_features, self.features_per_member, self.subspace_rule)


def _one_of(what, value, allowed):
    if value not in allowed:
        raise ValueError(f"{what} must be one of {allowed}, not {value!r}")
