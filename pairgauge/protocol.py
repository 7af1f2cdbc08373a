"""The two canonical benchmark protocols and the candidate grids they draw from."""

from __future__ import annotations

import itertools
import random
from dataclasses import asdict, dataclass

from . import constants as C


@dataclass(frozen=True)
class Protocol:
    name: str
    outer_seeds: tuple[int, ...]
    test_size: float
    inner_folds: int
    candidate_count: int
    tuning_seed: int = C.TUNING_SEED
    matrix_limit_bytes: int = C.MATRIX_LIMIT_BYTES
    recommendation_margin: float = C.MARGIN

    def as_record(self) -> dict:
        return {**asdict(self), "outer_seeds": list(self.outer_seeds)}


FULL = Protocol("full", (42, 137, 2026), 0.25, 3, 20)
SMOKE = Protocol("smoke", (42,), 0.25, 2, 2)


def protocol(name: str) -> Protocol:
    known = {p.name: p for p in (FULL, SMOKE)}
    if name not in known:
        raise ValueError(f"Unknown protocol {name!r}; choose one of {sorted(known)}.")
    return known[name]


# Search spaces: parameter name -> values, the last name varying fastest.
SEARCH_SPACE = {
    "GBDT": {
        "learning_rate": (0.03, 0.1),
        "max_leaf_nodes": (15, 31, 63),
        "l2_regularization": (0.0, 1.0, 10.0),
        "min_samples_leaf": (10, 20, 40),
    },
    "DNN": {
        "hidden_layer_sizes": ((32, 16), (64, 32), (128, 64)),
        "alpha": (0.0001, 0.001, 0.01),
        "learning_rate_init": (0.0003, 0.001, 0.003),
    },
}

# Candidate 0 of every search.
BASELINE = {
    "GBDT": {
        "learning_rate": 0.1,
        "max_leaf_nodes": 31,
        "l2_regularization": 0.0,
        "min_samples_leaf": 20,
    },
    "DNN": {"hidden_layer_sizes": (32, 16), "alpha": 0.0001, "learning_rate_init": 0.001},
}


def grid(family: str) -> list[dict]:
    """Every parameter combination of a family."""
    if family not in SEARCH_SPACE:
        raise ValueError(f"Unknown pipeline family {family!r}.")
    space = SEARCH_SPACE[family]
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def candidates(family: str, count: int, seed: int = C.TUNING_SEED) -> list[dict]:
    """Baseline first, then a seeded draw without replacement from the rest of the grid."""
    everything = grid(family)
    if not 1 <= count <= len(everything):
        raise ValueError(f"Candidate count must lie between 1 and {len(everything)}.")
    others = [point for point in everything if point != BASELINE[family]]
    drawn = random.Random(seed).sample(others, count - 1)
    return [BASELINE[family], *drawn]
