from datetime import datetime, timedelta

from fleetscope.operators import samples
from fleetscope.streaming import load

DDL = "con_id INT, sample_time TIMESTAMP_NTZ, session_state STRING, wait_class STRING, session_type STRING"
T0 = datetime(2024, 1, 1)


def test_stream_equals_batch(spark, frame, tmp_path):
    """Three arrivals, restarted between them, the last one late by hours: all buckets equal the batch result."""
    source = str(tmp_path / "in")

    def part(first, last):
        return frame(DDL, [(i % 2, T0 + timedelta(seconds=20 * (i // 3)), "ON CPU" if i % 5 else "WAITING", "User I/O",
                            "FOREGROUND") for i in range(first, last)])

    def run():
        rows = load.sample_stream(spark, source, part(0, 1).schema)
        counts = load.run_available(rows, load.load_counts(), str(tmp_path / "peak"), str(tmp_path / "peak_state"))
        states = load.run_available(rows, load.state_counts(), str(tmp_path / "states"), str(tmp_path / "states_state"))
        return load.peak_load(counts), load.active_by_state(states), load.peak_load(load.compact(counts))

    for first, last in ((100, 600), (600, 1500), (0, 100)):
        part(first, last).coalesce(1).write.mode("append").parquet(source)
        peaks, states, compacted = run()
    everything = spark.read.schema(part(0, 1).schema).parquet(source)
    batch = samples.peak_load([everything], "2024-01-01", "2025-01-01")
    assert sorted(map(tuple, peaks.collect())) == sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, compacted.collect())) == sorted(map(tuple, batch.collect()))
    hours = samples.active_by_state(everything, "2024-01-01", "2025-01-01")
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, hours.collect()))


def test_empty_stream(spark, frame, tmp_path):
    frame(DDL, []).write.parquet(str(tmp_path / "in"))
    rows = load.sample_stream(spark, str(tmp_path / "in"), frame(DDL, []).schema)
    counts = load.run_available(rows, load.load_counts(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert load.peak_load(counts).collect() == []
