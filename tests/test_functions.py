"""Functions and kernels against known values."""

import hashlib
import hmac
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.functions import documents, similarity, text
from tabsight.functions.quantiles import exact_quantiles
from tabsight.operators import statistics as S


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("x", "y"), [(" São Paulo ", "sao paulo"), ("Straße", "strasse"), ("ÇÃO", "cao"), (None, None)])
def test_fold(spark, x, y):
    assert _one(spark, x, text.fold) == y


def test_spellings(spark):
    keys = [_one(spark, x, text.spelling_key) for x in ("145", "145,00", "145.0", "S.P.", "sp", "1.234,50", "1234.5")]
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] and keys[5] == keys[6]


def test_person_key(spark):
    assert _one(spark, "Silva, MARÍA da", text.person_key) == "da maria silva"


def test_pseudonym_is_hmac(spark):
    for key in ("k", "k" * 80):
        assert _one(spark, "Maria", lambda c: text.pseudonym(c, key)) == hmac.new(key.encode(), b"Maria", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(("x", "y"), [("529.982.247-25", True), ("52998224725", True), ("529.982.247-26", False), ("111.111.111-11", False), ("", False), (None, False)])
def test_cpf(spark, x, y):
    assert _one(spark, x, documents.cpf_valid) is y


@pytest.mark.parametrize(("x", "y"), [("11.222.333/0001-81", True), ("11222333000181", True), ("11.222.333/0001-80", False)])
def test_cnpj(spark, x, y):
    assert _one(spark, x, documents.cnpj_valid) is y


def test_masks(spark):
    assert _one(spark, "ana@x.org", text.mask_email) == "a***@x.org"
    assert _one(spark, "Maria da Silva", text.mask_name) == "M*** d*** S***"
    assert _one(spark, "write to ana@x.org or 529.982.247-25", text.redact) == "write to [E-mail] or [CPF]"


def test_jaro_winkler():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd_") for _ in range(r.randint(1, 9))) for _ in range(2))
        assert similarity.jaro_winkler(a, b) == pytest.approx(duckdb.sql(f"SELECT jaro_winkler_similarity('{a}', '{b}')").fetchall()[0][0], abs=1e-9)


def test_token_sort_ratio():
    assert similarity.token_sort_ratio("maria silva", "silva maria") == 100
    assert similarity.common_subsequence("abcde", "acxe") == 3


def test_tails():
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert S.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, abs=1e-6)
    assert S._digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-9)


def test_medcouple():
    rng = np.random.default_rng(1)
    x = rng.normal(size=301)
    assert abs(S.medcouple(np.concatenate([x, -x]))) < 1e-9
    assert S.medcouple(np.exp(x)) > 0.2 and S.medcouple(-np.exp(x)) < -0.2


def test_shapiro():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)  # Shapiro and Wilk's example
    w, _ = S.shapiro(np.concatenate([x, x + 0.5]))
    assert 0.7 < w < 0.9
    rng = np.random.default_rng(2)
    assert S.shapiro(rng.normal(size=500))[1] > 0.01 and S.shapiro(rng.exponential(size=500))[1] < 1e-6


def test_series_tests():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=300)
    assert S.adf(noise)[1] < 0.01 and S.adf(np.cumsum(noise))[1] > 0.05
    assert S.ljung_box(noise)[1] > 0.01 and S.ljung_box(np.cumsum(noise))[1] < 1e-6


def test_best_distribution(spark):
    rng = np.random.default_rng(4)
    for kind, x in (("normal", rng.normal(5, 1, 800) - 10), ("exponential", rng.exponential(2, 800)), ("uniform", rng.uniform(1, 2, 800)), ("lognormal", np.exp(rng.normal(0, 0.8, 800)))):
        best = S.best_distribution(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect()
        assert best[0]["distribution"] == kind or best[0]["aic"] > best[1]["aic"] - 3
        assert best[0]["ks"] is None or best[0]["ks"] < 0.06


def test_mean_ci(spark):
    r = S.mean_ci(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "x double")).first()
    assert (r["mean"], round(r["hi"], 4)) == (3.0, round(3 + 2.7764451 * math.sqrt(2.5 / 5), 4))


@pytest.mark.parametrize(("accuracy", "collected"), [(10_000, 200_000), (20, 30)])
def test_quantiles_are_exact_however_coarse_the_sketches(spark, accuracy, collected):
    r = random.Random(1)
    rows = [(r.choice([0.0, 1.0, r.gauss(0, 100)]), i if i % 3 else None, 7.0, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, shares, accuracy, collected)
    want = df.agg(*(F.percentile(c, shares).alias(c) for c in "abc")).first()
    assert {c: got[c] for c in "abc"} == {c: pytest.approx(list(want[c])) for c in "abc"} and got["d"] is None


def test_a_sample_does_not_depend_on_the_layout_of_the_rows(spark):
    from tabsight.operators.columns import uniform_sample

    rows = [(i % 40, str(i % 40)) for i in range(200)]
    one, other = (sorted(tuple(r) for r in uniform_sample(spark.createDataFrame(x, "a int, b string").repartition(n), 50).collect()) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert one == other and len(one) == 50
