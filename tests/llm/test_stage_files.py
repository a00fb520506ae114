"""What stage boundaries leave in the shared folder."""

import os

from folioflow.llm import _common as C


def test_written_tables_hold_data_files_alone(spark):
    empty = C.written(spark.range(0), "empty")
    full = C.written(spark.range(50).repartition(3), "full")
    assert empty.count() == 0 and empty.columns == ["id"] and full.count() == 50
    for df in (empty, full):
        names = os.listdir(df._folioflow_path.removeprefix("file://"))
        assert names and all(n.lstrip(".").startswith("part-") for n in names)
    C.discard(empty, full)


def test_the_driver_forks_no_process_for_the_folders_of_a_table(spark, tmp_path):
    """Hadoop without its native library forks the JVM to set a new folder's permissions; the flight recorder sees each fork."""
    jvm = spark._jvm
    dump = jvm.java.io.File(f"{tmp_path}/forks.jfr").toPath()
    recording = jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart").withStackTrace()
    recording.start()
    table = C.written(spark.range(50).repartition(3), "forks")
    recording.stop()
    recording.dump(dump)
    recording.close()
    events = jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(dump)
    frames = [[f.getMethod().getName() for f in e.getStackTrace().getFrames()] for e in events if e.getStackTrace() is not None]
    assert not [f for f in frames if "setupJob" in f]
    assert sorted(r.id for r in table.collect()) == list(range(50))
    C.discard(table)
