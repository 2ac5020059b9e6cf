from quarry.operators import report
from quarry.plans import adapters
from quarry.streaming import incremental

from .conftest import SMALL, rows


def test_a_restart_reports_nothing_twice(spark, tmp_path):
    f = adapters.findings(spark, SMALL)
    none, base = adapters.ignores(spark, SMALL), report.fingerprinted(f).limit(0)
    for k in (1, 2):
        f.write.mode("append").parquet(f"file://{tmp_path}/in")  # the same findings arrive again
        q = incremental.new_findings(spark.readStream.schema(f.schema).parquet(f"file://{tmp_path}/in"), none, base, f"file://{tmp_path}/state", f"file://{tmp_path}/check")
        q.awaitTermination(120)
        got = spark.read.parquet(f"file://{tmp_path}/state")
        assert got.count() == f.count() == got.select("fingerprint").distinct().count(), k
    assert rows(got.select("fingerprint")) == rows(report.fingerprinted(f).select("fingerprint"))
