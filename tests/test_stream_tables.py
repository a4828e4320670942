from pyspark.sql import functions as F

from wardline.plans import fixtures
from wardline.plans.queries import QUERIES, _stream


def test_a_table_in_a_folder_streams_as_one_in_a_file(spark, small, tmp_path):
    """A table of several files is a folder with the table's name."""
    for name in ("documents", "events"):
        fixtures.read(spark, small, name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path)
    assert _stream(spark, folder, "documents").schema == fixtures.read(spark, small, "documents").schema
    for query in ("stream_score", "stream_verdicts", "stream_counts"):
        rows = lambda d: QUERIES[query](spark, d).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*"))).first()  # noqa: E731, B023
        found = rows(folder)
        assert found == rows(small) and found[0]
