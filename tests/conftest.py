import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from exprstudy.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("exprstudy-tests", 8, 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def planted(spark, n_per_class=12, classes=("A", "B", "C"), n_genes=9, strength=6.0, seed=7, missing=0.0):
    """A positive matrix where class i has three own genes raised; returns rows and the numpy array."""
    import numpy as np

    rng = np.random.default_rng(seed)
    values = rng.lognormal(0.0, 0.4, size=(n_per_class * len(classes), n_genes)).astype("float32")
    labels = [c for c in classes for _ in range(n_per_class)]
    own = max(1, n_genes // len(classes))
    for i, label in enumerate(labels):
        first = classes.index(label) * own
        values[i, first : first + own] *= strength
    if missing:
        values[rng.random(values.shape) < missing] = float("nan")
    rows = [(i, f"P{i:04d}", labels[i], [float(v) for v in values[i]]) for i in range(len(labels))]
    schema = "cache_index bigint, participant_barcode string, cancer_type string, features array<float>"
    return spark.createDataFrame(rows, schema), values, labels


def gene_table(spark, n):
    rows = [(i, f"G{i}|{i}", f"G{i}", str(i)) for i in range(n)]
    return spark.createDataFrame(rows, "gene_index int, source_gene_id string, symbol string, entrez_id string")
