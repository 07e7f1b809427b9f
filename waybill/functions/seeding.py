"""What a seed reaches, and what it doesn't."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

#: Sources of randomness that no seed here governs.
UNCONTROLLED = ("operating system entropy", "worker processes of third parties", "non-deterministic GPU kernels", "wall-clock seeds inside a subject")


@dataclass
class SeedReport:
    """The seed, the generators it reached and those that stay out of reach."""

    seed: int
    reached: list[str] = field(default_factory=list)
    uncontrolled: tuple[str, ...] = UNCONTROLLED


def seed_all(seed: int) -> SeedReport:
    """Seed the generators of this process that can be seeded, and say which."""
    report = SeedReport(seed)
    random.seed(seed)
    report.reached.append("random")
    try:
        import numpy as np
    except ImportError:
        return report
    np.random.seed(seed % 2**32)
    report.reached.append("numpy")
    return report
