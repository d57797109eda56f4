import math

from palimpsest.llm import near_dedup


def test_pairs_of_hot_values_are_listed():
    """A node of which three quarters is a hot passage lists hot values but with a chance below MISS."""
    plan = near_dedup.DOCUMENTS
    most = int(plan.dominated * plan.k)
    assert sum(math.comb(plan.k, m) * 0.75**m * 0.25 ** (plan.k - m) for m in range(most + 1)) < near_dedup.MISS
