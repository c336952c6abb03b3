import numpy as np
import pytest
from compare import duck, same

from tierloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    same(catalogue.queries()[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql(spark, sf_dir, name):
    """What SQL can't express, by its shape; the kernels themselves are tested against brute force and known signals in test_dsp."""
    df = catalogue.queries()[name](spark, sf_dir)
    got = df.toPandas()
    assert len(got) and list(got.columns) == df.columns
    if "vec_id" in df.columns:
        ids = {r[0] for r in catalogue.read(spark, sf_dir, "embeddings").select("vec_id").collect()}
        assert set(got.vec_id) <= ids and len(set(got.vec_id)) > 0.5 * len(ids)
    empty = {c for c in got.columns if got[c].isna().all()}
    # short frames have no fifth and sixth formant, inverse filters never do; repeated vectors fit no common denominator
    assert empty <= {"F5", "F6", "B4", "B5", "B6"} | ({"f0"} if name == "get_f0_acd" else set()), empty
    for c in got.select_dtypes("number").columns:
        assert np.isfinite(got[c].dropna()).all(), c
    for c, low in (("f0", 0), ("F1", 0), ("OQ", 0), ("c", 0), ("power", 0), ("fs", 1)):
        if c in got.columns and got[c].dtype.kind == "f":
            assert (got[c].dropna() >= low).all(), c
    again = catalogue.queries()[name](spark, sf_dir).toPandas()
    key = [c for c in got.columns if got[c].dtype.kind in "ifb"]
    assert again.sort_values(key)[key].reset_index(drop=True).equals(got.sort_values(key)[key].reset_index(drop=True))
