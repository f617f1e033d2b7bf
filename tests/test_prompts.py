"""Requests of continuous mode, by link, and with the outline of their range."""

from __future__ import annotations

from cuespark.operators import prompts


def test_continuous_requests(spark):
    samples = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 2, 4, 10, 12])] + [(2, 0, 3.0)], "video_id long, ord long, t_sec double")
    got = {(r.video_id, r.batch): r for r in prompts.continuous_requests(samples, 3, 2.5).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0)]
    lines = got[1, 0].prompt.split("\n")
    assert [x for x in lines if x.startswith("Image")] == ["Image 1: 00:00:00.000", "Image 2: 00:00:02.000", "Image 3: 00:00:04.000"]
    assert "Range: 00:00:00.000 - 00:00:04.000" in lines and "At most 10 words." in lines
    assert "At most 1 words." in got[2, 0].prompt and (got[1, 1].t0, got[1, 1].t1, got[1, 1].n) == (10.0, 12.0, 2)


def test_outline_of_the_range(spark):
    asked = spark.createDataFrame([(1, 0, 0.0, 10.0, "p"), (1, 1, 10.0, 200.0, "q"), (2, 0, 0.0, 5.0, "r"), (None, 0, 0.0, 5.0, "s")],
                                  "video_id long, batch int, t0 double, t1 double, prompt string")
    outline = spark.createDataFrame([(1, 5.0, 130.0, "two"), (1, 0.0, 5.0, "one"), (1, 0.0, 5.0, "one"), (1, 1.0, 2.0, " "), (1, 1.0, 2.0, None), (3, 0.0, 9.0, "no")],
                                    "video_id long, start_sec double, end_sec double, summary string")
    got = {(r.video_id, r.batch): r.prompt for r in prompts.with_outline(asked, outline).collect()}
    first, second = "00:00:00.000 - 00:00:05.000: one", "00:00:05.000 - 00:02:10.000: two"
    assert got == {(1, 0): f"p\nOutline here:\n{first}\n{first}\n{second}", (1, 1): f"q\nOutline here:\n{second}", (2, 0): "r", (None, 0): "s"}


def test_link_requests(spark):
    chunks = spark.createDataFrame([(1, 0, 0.0, 60.0, "https://v/1"), (1, 1, 60.0, 60.2, "https://v/1"), (2, 0, 0.0, 9.0, None), (3, 0, 0.0, 9.0, "")],
                                   "video_id long, chunk_index int, start_sec double, end_sec double, url string")
    got = {(r.video_id, r.chunk_index): r.prompt.split("\n") for r in prompts.link_requests(chunks, 3.0).collect()}
    assert sorted(got) == [(1, 0), (1, 1)]
    assert got[1, 0][:4] == ["Watch https://v/1", "Narrate all of 00:00:00.000 - 00:01:00.000", "At most 180 words.", "Open with a hook."]
    assert got[1, 1][2:4] == ["At most 1 words.", "Continue the story."]
