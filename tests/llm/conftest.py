import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "so", "ni", "pa") for b in ("ran", "del", "mor", "tis", "ven", "lak", "som", "bur", "nok", "zet") for c in ("", "a", "el", "ix", "on", "um")]


@pytest.fixture
def prose():
    """Random texts of invented words."""
    rng = random.Random(11)

    def make(n, seed=None):
        source = rng if seed is None else random.Random(seed)
        return " ".join(source.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """doc_id, text and optional language, source as a frame, with columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s0")), 5, True, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, component_id long, kept boolean, spans string, x double")

    return make
