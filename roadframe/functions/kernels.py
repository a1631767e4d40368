"""Fixed filter weights, computed once on the driver and shipped as literals."""

from __future__ import annotations

import math


def gaussian_weights(sigma: float) -> list[float]:
    """Weights for offsets -r..r with r = int(4 sigma + 0.5), summing to one."""
    r = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(raw)
    return [w / total for w in raw]
