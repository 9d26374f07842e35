import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import folded, normal_code, readable_day

CODES = {
    "sh600519": "sh600519",
    " SZ002241 ": "sz002241",
    "600519.SH": "sh600519",
    "002241sz": "sz002241",
    "SZ-000001": "sz000001",
    "sh.510300": "sh510300",
    "600519": "sh600519",
    "159915": "sz159915",
    "430047": "bj430047",
    "ｓｈ６００５１９": "sh600519",
    "sz00O7I5": "sz000715",
    "O00725": "sz000725",
    "sh600519​": "sh600519",
    "sh6005190": None,
    "sh60051": None,
    "sh60x519": None,
    "hk00700": None,
    "#N/A": None,
    "": None,
    "  ": None,
    "271234": None,
    None: None,
}
DAYS = {
    "2024-02-29": "2024-02-29",
    "2023-02-29": None,
    "20240131": "2024-01-31",
    "20240131154608": "2024-01-31",
    "2024-1-3": "2024-01-03",
    "2024/01/03": "2024-01-03",
    "2024.01.03": "2024-01-03",
    "2024年1月3日": "2024-01-03",
    " 2024-01-03 ": "2024-01-03",
    "2024-01-03 15:00:00": "2024-01-03",
    "2024-01-03T15:00:00": "2024-01-03",
    "0000-00-00": None,
    "2024-13-40": None,
    "n/a": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("fn,cases", [(normal_code, CODES), (readable_day, {k: v and datetime.date.fromisoformat(v) for k, v in DAYS.items()})])
def test_normal_forms(spark, fn, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in df.select("x", fn(F.col("x")).alias("y")).collect()}
    assert got == cases


def test_folded(spark):
    df = spark.createDataFrame([("  Large ",), ("",), ("​",), (None,), ("盐化工 ",)], "x string")
    assert [r[0] for r in df.select(folded(F.col("x"))).collect()] == ["large", None, None, None, "盐化工"]
