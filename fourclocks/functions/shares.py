"""Share, weight and score arithmetic as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SHARE_FLOOR = 0.001
MODE_QUALITY = {"live_phone": 1.0, "mixed": 0.95, "online": 0.90, "ivr": 0.82}
OTHER_MODE_QUALITY = 0.85
VOLATILITY_CAP = 0.18


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left + right, values)


def normalise_vector(values: Sequence[Column], floor: float | None = SHARE_FLOOR) -> list[Column]:
    """Clip each entry at the floor, then divide by the sum."""
    clipped = [F.greatest(v, F.lit(floor)) if floor is not None else v for v in values]
    return [v / total(clipped) for v in clipped]


def entries(vector: Column | str, size: int) -> list[Column]:
    column = F.col(vector) if isinstance(vector, str) else vector
    return [column.getItem(i) for i in range(size)]


def blend(prior: Sequence[Column], poll: Sequence[Column], weight: Column) -> list[Column]:
    """Convex mix of two vectors, rescaled to sum to one without a floor."""
    mixed = [(F.lit(1.0) - weight) * a + weight * b for a, b in zip(prior, poll, strict=True)]
    return [v / total(mixed) for v in mixed]


def half_life(age: Column, days: float) -> Column:
    return F.exp(F.lit(-math.log(2)) * age / F.lit(float(days)))


def mode_quality(mode: Column) -> Column:
    chain = F.lit(OTHER_MODE_QUALITY)
    for name, weight in MODE_QUALITY.items():
        chain = F.when(mode == name, F.lit(weight)).otherwise(chain)
    return chain


def horizon_scale(days: Column, reference: float = 90.0) -> Column:
    ratio = F.greatest(days, F.lit(7)) / F.lit(float(reference))
    return F.least(F.lit(1.60), F.greatest(F.lit(0.75), F.pow(ratio, F.lit(0.18))))


def effective_volatility(base: Column, scale: Column, poll_variance: Column) -> Column:
    """Scaled volatility, lifted to the largest poll dispersion and capped."""
    spread = F.sqrt(F.greatest(F.coalesce(poll_variance, F.lit(0.0)), F.lit(0.0)))
    return F.least(F.lit(VOLATILITY_CAP), F.greatest(base * scale, spread))


def logit(share: Column) -> Column:
    clipped = F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99))
    return F.ln(clipped / (F.lit(1.0) - clipped))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def entropy_bits(p: Column) -> Column:
    """Binary entropy; zero at both ends."""
    q = F.lit(1.0) - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p)) - q * F.log2(q))


def mc_se(p: Column, draws: Column) -> Column:
    """Monte-Carlo standard error in percentage points."""
    return F.sqrt(p * (F.lit(1.0) - p) / draws) * F.lit(100.0)


def interval_width(low: Column, high: Column) -> Column:
    return high - low


def horizon_tolerance(days: Column) -> Column:
    tenth = F.ceil(days * F.lit(0.10)).cast("int")
    return F.greatest(F.lit(2), F.least(F.lit(30), tenth))


# Lower bounds and labels of the probability bands.
PROBABILITY_BANDS = (
    (0.8, "STRONG FAVORITE"),
    (0.6, "FAVORED"),
    (0.4, "COMPETITIVE"),
    (0.2, "UNDERDOG · REAL PATH"),
)


def probability_label(p: Column) -> Column:
    chain = F.lit("LONG SHOT")
    for bound, label in reversed(PROBABILITY_BANDS):
        chain = F.when(p >= bound, label).otherwise(chain)
    return chain


def movement_state(previous: Column, current: Column, eps: float = 0.003) -> Column:
    """0 fell, 1 flat, 2 rose; both limits strict."""
    step = current - previous
    return F.when(step < -eps, 0).when(step > eps, 2).otherwise(1)


def rank_descending(values: Sequence[Column], position: int) -> Column:
    """0-based rank of one entry among a few, ties to the lower position."""
    here = values[position]
    ahead = [
        F.when((v > here) | ((v == here) & F.lit(i < position)), 1).otherwise(0)
        for i, v in enumerate(values)
        if i != position
    ]
    return total(ahead) if ahead else F.lit(0)


def argmax_position(values: Sequence[Column]) -> Column:
    """Index of the largest entry, the first one on ties."""
    best = F.greatest(*values) if len(values) > 1 else values[0]
    chain = F.lit(len(values) - 1)
    for i in range(len(values) - 2, -1, -1):
        chain = F.when(values[i] == best, F.lit(i)).otherwise(chain)
    return chain


def remainder_seats(shares: Sequence[Column], seats: Column) -> list[Column]:
    """Largest-remainder seats of one row's share vector, in row-local arithmetic."""
    scale = total(shares)
    quotas = [s / scale * seats for s in shares]
    base = [F.floor(q) for q in quotas]
    rest = [q - b for q, b in zip(quotas, base, strict=True)]
    left = seats - total(base)
    return [
        (base[i] + F.when(rank_descending(rest, i) < left, 1).otherwise(0)).cast("int")
        for i in range(len(shares))
    ]


def double_centre(matrix: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """P*C*P with P = I - 1/k, written as row, column and grand means."""
    k = len(matrix)
    rows = [total(row) / k for row in matrix]
    cols = [total([matrix[i][j] for i in range(k)]) / k for j in range(k)]
    grand = total(rows) / k
    return [[matrix[i][j] - rows[i] - cols[j] + grand for j in range(k)] for i in range(k)]


def member_subsets(count: int) -> list[tuple[int, ...]]:
    """Positions of every coalition of two up to all-but-one members."""
    return [m for size in range(2, count) for m in combinations(range(count), size)]
