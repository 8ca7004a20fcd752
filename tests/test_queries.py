"""Every query of the catalog runs; those with SQL agree with it, value by value."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewatch.plans import catalog


def canonical(df: pd.DataFrame) -> list:
    def show(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        # One side may hold whole numbers as floats, as pandas does for columns with nulls.
        return repr(round(float(v), 6)) if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
        want = con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
