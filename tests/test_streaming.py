"""Streams of graph files."""

from pairstrand.streaming import graph_lines


def test_files_are_read_once(spark, tmp_path):
    folder, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    folder.mkdir()
    (folder / "a.gfa").write_text("H\tVN:Z:1.0\nS\ts1\tACGT\tLN:i:4\trd:i:3\n\nL\ts1\t+\ts1\t-\t2M\n")

    def run():
        graph_lines.append_to(graph_lines.segments(graph_lines.lines(spark, str(folder))), str(out), str(mark)).awaitTermination()
        return sorted((r["seg_id"], r["length"], r["support"]) for r in spark.read.parquet(str(out)).collect())

    assert run() == [("s1", 4, 3.0)]
    (folder / "b.gfa").write_text("S\ts2\t*\tLN:i:7\trd:i:1\n")
    assert run() == [("s1", 4, 3.0), ("s2", 7, 1.0)]
    assert run() == [("s1", 4, 3.0), ("s2", 7, 1.0)]


def test_totals(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("S\ts1\tACGT\tLN:i:4\nS\ts2\tAC\tLN:i:2\n")
    stream = graph_lines.segment_totals(graph_lines.lines(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.sql("SELECT * FROM totals").first()) == (2, 6)
