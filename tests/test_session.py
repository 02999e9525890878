import pytest

from weirflow.session import SessionOptions


def test_settings():
    assert SessionOptions().settings() == {"spark.master": "local[*]"}
    assert SessionOptions(cores=2, memory=64 << 20, temp_dir="/t", shared_dir="file:///s").settings() == {"spark.master": "local[2]", "spark.driver.memory": "364m", "spark.local.dir": "/t", "spark.checkpoint.dir": "file:///s"}
    got = SessionOptions(coordinator_host="c", host="h", port=1, workers=3, cores=4, join_timeout=5, rpc_timeout=2.5, memory=1 << 30).settings()
    assert got["spark.master"] == "spark://c:7077" and got["spark.executor.instances"] == "3" and got["spark.executor.cores"] == "4" and got["spark.executor.memory"] == "1324m"
    assert got["spark.network.timeout"] == "2.5s" and got["spark.scheduler.maxRegisteredResourcesWaitingTime"] == "5s" and got["spark.driver.port"] == "1"
    for bad in ({"memory": 1}, {"workers": 0}):
        with pytest.raises(ValueError):
            SessionOptions(**bad)
