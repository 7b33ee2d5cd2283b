"""Keyed state in streams holds many keys in a bucket."""

from test_keyed_stream import feed



def test_python_is_called_by_bucket(spark, tmp_path):
    """2,000 keys in 8 buckets at most; a stream that goes on knows each, and its own first rows stay."""
    rows = [(i, "a", 5 + n, n, "2024-01-01") for i in range(2000) for n in (1, 0)]
    first = feed(spark, tmp_path, rows, buckets=8)
    assert first == [(i, "a", 5, 0) for i in range(2000)]
    assert feed(spark, tmp_path, [(i, "a", 0, 9, "2024-01-02") for i in range(2001)], buckets=8) == [*first, (2000, "a", 0, 9)]
    held = spark.read.format("statestore").load(f"{tmp_path}/cp")
    assert 1 <= held.count() <= 8


def test_keys_of_one_bucket_are_forgotten_by_their_own_times(spark, tmp_path):
    options = {"ttl_seconds": 3600, "late": "0 seconds", "buckets": 1}
    feed(spark, tmp_path, [(1, "a", 1, 1, "2024-01-01 00:00:00"), (2, "a", 1, 1, "2024-01-01 00:50:00")], **options)
    feed(spark, tmp_path, [(1, "a", 1, 2, "2024-01-01 00:55:00"), (3, "a", 1, 1, "2024-01-01 01:20:00")], **options)
    got = feed(spark, tmp_path, [(1, "a", 1, 3, "2024-01-01 01:30:00"), (2, "a", 1, 3, "2024-01-01 01:30:00")], **options)
    assert got == [(1, "a", 1, 1), (1, "a", 1, 3), (2, "a", 1, 1), (3, "a", 1, 1)]
