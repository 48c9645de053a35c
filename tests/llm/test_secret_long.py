"""Long candidate strings, which a backtracking matcher can't recurse through."""

import pytest

from harvestline.llm import secrets


@pytest.mark.parametrize("unit, n, secret", [("aB-12-xY-", 22_000, False), ("a-1-", 50_000, False), ("A1b+/", 40_000, False), ("Zx8Kq2Lm9Vb4Nc7Rt1Yp5Ws3", 400, True), ("a" * 30 + "=", 2_000, False)])
def test_long_candidates(spark, unit, n, secret):
    df = spark.createDataFrame([(1, "x " + unit * n + " y"), (2, "key Zx8Kq2Lm9Vb4Nc7Rt1Yp5Ws3 here")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.find_secrets(df)).collect()}
    assert (f"entropy:2:{2 + len(unit) * n}" in got[1]) == secret and got[2] == "entropy:4:28"
