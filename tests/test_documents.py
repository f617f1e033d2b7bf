"""Packed documents: in order, whole over several files, read by key."""

from __future__ import annotations

from cuespark.sources.documents import export_documents, pack_documents, read_documents, read_lines, unpack_documents


def lines_of(spark):
    """A document with most of all lines, short ones, one without text and lines of a null key."""
    rows = [(1, n, f"é{n}" if n % 7 else "") for n in range(3000)] + [(k, n, f"{k}:{n}") for k in range(2, 40) for n in range(3)]
    rows += [(50, 0, ""), (None, 0, "x")]
    return spark.createDataFrame(rows[::-1], "video_id long, n long, line string"), rows


def expected(rows):
    texts = {}
    for key, n, line in sorted(rows, key=lambda r: r[1]):
        texts[key] = texts.get(key, "") + line + "\n"
    return texts


def test_packed_documents(spark, tmp_path):
    lines, rows = lines_of(spark)
    path = str(tmp_path / "packed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small pieces would share a file
    pack_documents(lines, path, "video_id", ["n"], "line")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.video_id: r.document for r in unpack_documents(spark, path, "video_id", ["n"], "line").collect()}
    assert got == expected(rows)
    files = list((tmp_path / "packed").glob("part-*.parquet"))
    assert len(files) <= 4  # as many as there are tasks, not one a document
    holds = read_lines(spark, path, "video_id", [1]).selectExpr("_metadata.file_path AS f").distinct().count()
    assert holds > 1  # the long document lies in several files
    some = {r.video_id for r in unpack_documents(spark, path, "video_id", ["n"], "line", [3, 50, 99]).collect()}
    assert some == {3, 50}
    plan = read_lines(spark, path, "video_id", [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(video_id), EqualTo(video_id,3)]" in plan


def test_export_of_packed_documents(spark, tmp_path):
    lines, rows = lines_of(spark)
    path, target = str(tmp_path / "packed"), str(tmp_path / "files")
    pack_documents(lines, path, "video_id", ["n"], "line")
    export_documents(spark, path, target, "video_id", ["n"], "line", [1, 5, 50])
    got = {int(r.video_id): r.document for r in read_documents(spark, target, "video_id").collect()}
    assert got == {k: v for k, v in expected(rows).items() if k in (1, 5, 50)}


def test_packed_empty_table(spark, tmp_path):
    path = str(tmp_path / "packed")
    pack_documents(lines_of(spark)[0].limit(0), path, "video_id", ["n"], "line")
    assert unpack_documents(spark, path, "video_id", ["n"], "line").count() == 0
