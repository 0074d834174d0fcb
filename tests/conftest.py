import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orchard_pdf():
    """Trees of an orchard, 240 rows: every eighth height is unknown, one site, weights in two units, a grade that follows from
    the blight, one tree with a storm-like yield, and the last three rows entered twice."""
    rng = np.random.default_rng(2024)
    n = 237
    age = rng.integers(2, 40, n)
    weight = 20 + rng.gamma(3.0, 4.0, n)
    blight = (rng.random(n) < 0.35).astype(int)
    crop = rng.gamma(2.0, 4.0, n)
    crop[50] = 900.0
    pdf = pd.DataFrame({
        "height": np.where(np.arange(n) % 8 == 0, np.nan, 1.2 + age * 0.08 + rng.normal(scale=0.9, size=n)), "site": 7, "age": age,
        "weight": weight, "weight_correlated": weight * 2.2046 + rng.uniform(-0.05, 0.05, n), "crop": crop,
        "grade": 4 - 3 * blight + rng.uniform(-0.1, 0.1, n), "blight": blight})
    return pd.concat([pdf, pdf.tail(3)], ignore_index=True)


@pytest.fixture(scope="session")
def orchard_df(spark, orchard_pdf):
    return spark.createDataFrame(orchard_pdf)


def rows(df, *names):
    """Collected rows as tuples, floats left as they are."""
    return [tuple(r[n] for n in (names or df.columns)) for r in df.collect()]


def by(df, key="feature"):
    return {r[key]: r.asDict() for r in df.collect()}
