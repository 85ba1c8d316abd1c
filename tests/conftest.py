import pandas as pd
import pytest

from clickfeat.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def small_slices(spark):
    """Skew settings small enough for fixtures to reach the hot-key paths."""
    settings = {
        "spark.clickfeat.hotRows": "20",
        "spark.clickfeat.sliceRows": "16",
        "spark.clickfeat.broadcastRows": "10",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture(scope="session")
def clicks(spark):
    from clickfeat.sources.readers import read_clicks

    return read_clicks(spark, DATA)


def skewed_frame(n: int = 400) -> pd.DataFrame:
    """A third of the rows belong to one ip; row order is time order, with ties and long gaps."""
    i = pd.Series(range(n))
    return pd.DataFrame(
        {
            "row_id": i,
            "ip": i.where(i % 3 != 0, 0) % 37,
            "app": (i * 7) % 5,
            "device": (i % 11 == 0).astype(int),
            "os": i % 4,
            "channel": (i * 13) % 17,
            "click_time": pd.Timestamp("2020-03-01") + pd.to_timedelta((i // 2) * 1311 + (i > n // 2) * 200000, unit="s"),
            "is_attributed": (i % 9 == 0).astype(int),
        }
    ).assign(day=lambda d: d.click_time.dt.day, hour=lambda d: d.click_time.dt.hour)


@pytest.fixture()
def skewed(spark):
    return spark.createDataFrame(skewed_frame())
