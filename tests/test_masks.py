"""The masks of columns and of streams agree with each other and with the SQL, over all of Unicode."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.functions import security
from loomwright.plans.registry import _sql_mask
from loomwright.streaming import masking

CASES = {
    "joão@x.com": "[EMAIL]", "josé.silva@exemplo.com.br.": "[EMAIL].", "fale: (61) 99999-8888!": "fale: [TELEFONE]!", "１２３.456.789-09": "[CPF]",
    "cpf １２３４５６７８９０１ ok": "cpf [CPF] ok", "12.345.678/0001-95 70000-000": "[CNPJ] [CEP]", "é12345-678": "é12345-678", "-.+a@b.co-": "-.+[EMAIL]-", 
    "a@b..c @x.y a@@b.c": "[EMAIL] @x.y a@@b.c", "1@2.3": "[EMAIL]", "": "", "sem nada": "sem nada", "日本@例え.テスト": "[EMAIL]", "a.b" * 20000: "a.b" * 20000,
}
AFTER = ["a@b.c.+d@e.f", "a@b.c.-d@e.f x@y.z+k@l.m"]
ALPHABET = ["@", ".", "-", "+", "_", " ", " ", "\n", " ", "\x1c", "\x85", "(", ")", "/", "é", "ß", "日", "ａ", "９", "9", "1", "23", "456", "12345678901", "a", "b.c", "x@y.zw", "½", "²", "́", "👍"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return list(CASES) + AFTER + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 24))) for _ in range(3000)]


def test_columns_mask_as_streams_do(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["m"] for r in rows.select("i", security.mask_pii(F.col("t")).alias("m")).collect()}
    assert got.pop(-1) is None
    assert [t for i, t in enumerate(texts) if got[i] != masking.mask(t)] == []
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_sql_masks_as_columns_do(texts):
    plain = [t for t in texts[: len(CASES)] if t]
    c = duckdb.connect()
    got = c.execute(f"SELECT {_sql_mask('t')} FROM (SELECT unnest(?) AS t)", [plain]).fetchall()
    assert [g for g, in got] == [CASES[t] for t in plain]
