"""Every registered query of the engine with SQL, row by row against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from quillon.functions import quantize as Q
from quillon.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


def test_quality_of_approximations(spark):
    recall = {(r["bits"], r["rerank"]): r["recall"] for r in QUERIES["quant_recall"](spark, SF).collect()}
    assert recall[4, False] >= 0.7 and recall[4, True] >= 0.98 and recall[8, False] >= 0.95
    for r in QUERIES["dequantized_error"](spark, SF).collect():
        assert abs(r["mse"] - r["expected"]) < 0.25 * r["expected"]
    probes = {r["nprobe"]: r["recall"] for r in QUERIES["ivf_recall"](spark, SF).collect()}
    assert probes[1] < probes[4] < probes[16] == 1.0
    assert QUERIES["graph_recall"](spark, SF).first()["recall"] >= 0.9
    assert max(r["error"] for r in QUERIES["half_precision"](spark, SF).collect()) < 1e-3


def test_entry_imports_without_the_optional_subpackage():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_codes_and_sketches():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((2000, 48))
    for bits in (1, 2, 3, 5, 8):
        codes = rng.integers(0, 1 << bits, (50, 48)).astype(np.uint8)
        assert (Q.unpack(Q.pack(codes, bits), bits, 48) == codes).all()
    z = Q.Quantizer.make(48, 2, sketch=True)
    codes, norms = z.encode(v)
    assert np.abs(z.rotation @ z.rotation.T - np.eye(48)).max() < 1e-9
    signs, gamma = z.signs(v, codes)
    unit = v / norms[:, None]
    plain = z.decode(codes, np.ones(len(v)))
    better = worse = 0
    for q in unit[:20]:
        exact = unit @ q
        corrected = plain @ q + z.residual_dot(q, signs, gamma)
        better += abs((corrected - exact).mean()) < 0.02
        worse += np.abs(corrected - exact).mean() > 0.1
    assert better == 20 and worse == 0
    h = Q.walsh_hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(Q.hadamard_rotation(16) @ Q.hadamard_rotation(16).T, np.eye(16))
    r = Q.hadamard_rotation(12)
    assert r.shape == (16, 12) and np.allclose(r.T @ r, np.eye(12))
    assert Q.expected_error(Q.codebook(4, 64), 64) < Q.expected_error(Q.codebook(2, 64), 64)
