"""Literal cases: inputs with the exact results they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuespark.functions import scoring, text, timecode, voices
from cuespark.operators import fit, highlights, ledger, mix, planning, ranges, responses, retime, segments, signal, subtitles
from cuespark.params import ChunkParams, FitParams, HighlightParams, PauseParams, ScriptParams, WindowParams
from cuespark.sources import logs, media, scripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---------------------------------------------------------------- scalars
@pytest.mark.parametrize("given, seconds", [
    ("00:00:01.500", 1.5), ("01:05.2", 65.2), ("12.5", 12.5), ("00:00:01,500", 1.5), (" 7 ", 7.0), ("1:2:3:4", None), ("", None), ("x", None), ("-4", None)])
def test_parse_timestamp(spark, given, seconds):
    assert one(spark, timecode.parse_timestamp(F.lit(given))) == seconds


@pytest.mark.parametrize("sec, clock", [(0.0, "00:00:00.000"), (3661.5, "01:01:01.500"), (90000.0, "25:00:00.000"), (-3.0, "00:00:00.000"), (0.0005, "00:00:00.000"), (0.0015, "00:00:00.002")])
def test_format_timestamp(spark, sec, clock):
    assert one(spark, timecode.format_timestamp(F.lit(sec))) == clock
    assert one(spark, timecode.srt_timestamp(F.lit(sec))) == clock.replace(".", ",")


def test_text_functions(spark):
    assert one(spark, text.strip_accents(F.lit("Đường phố Ñandú á"))) == "Duong pho Nandu a"
    assert one(spark, text.count_words(F.lit("Xin chào, thế_giới 12!"))) == 4
    assert one(spark, text.count_words(F.lit(None).cast("string"))) == 0
    assert one(spark, text.clean_text(F.lit("  **Chào**   bạn 🎉\n~x~ "))) == "Chào bạn x"
    assert one(spark, text.clean_speech_text(F.lit("<b>a</b>  _c_"))) == "ba/b c"
    assert one(spark, text.snippet(F.lit("a\n b   c"), 3)) == "a b"


@pytest.mark.parametrize("given, tone", [("Vui_Vẻ", "vui ve"), ("EXCITED", "hao hung"), ("calm-deep", "tram am"), ("Nghiêm túc", "tram am"), (None, "trung tinh"), ("odd", "trung tinh")])
def test_tone(spark, given, tone):
    assert one(spark, text.normalize_tone(F.lit(given).cast("string"))) == tone


@pytest.mark.parametrize("given, label", [(" Safe_Inference ", "safe_inference"), ("guess", "observed_fact"), (None, "observed_fact"), ("creative_framing", "creative_framing")])
def test_certainty(spark, given, label):
    assert one(spark, text.normalize_certainty(F.lit(given).cast("string"))) == label


@pytest.mark.parametrize("given, limit, short", [
    ("one two three four five", 3, "one two three."), ("One two, three. four five six", 4, "One two, three."), ("a, b c d e f g h", 7, "a, b c d e f g."),
    ("well-known fact here", 2, "well-known."), ("Stop! now", 1, "Stop!")])
def test_truncate_words(spark, given, limit, short):
    assert one(spark, text.truncate_words(F.lit(given), F.lit(limit))) == short


def test_wrap(spark):
    assert one(spark, text.wrap_two_lines(F.lit("aaa bbb ccc ddd"), 7)) == "aaa bbb\nccc ddd"
    assert one(spark, text.wrap_two_lines(F.lit("aaa bbb ccc ddd eee"), 7)) == "aaa bbb\nccc ddd eee"
    assert one(spark, text.wrap_two_lines(F.lit("longerthanthat x"), 5)) == "longerthanthat\nx"


def test_missing_marks(spark):
    flag = lambda t, lang="vi": one(spark, text.missing_marks(F.lit(t), F.lit(lang)))
    assert flag("giua dai ngan bao la") and not flag("giữa đại ngàn bao la") and not flag("ngan") and not flag("plain english text", "en")


def test_composite_score(spark):
    names = [*scoring.CRITERIA_WEIGHTS, "redundancy_penalty"]

    def score(plain=None, **raw):
        cols = {n: F.lit(raw.get(n)).cast("string") for n in names}
        return one(spark, F.round(scoring.composite_score(cols, F.lit(plain).cast("string")), 9))
    ones = {n: "1" for n in scoring.CRITERIA_WEIGHTS}
    assert score(**ones) == 9.0 and score(**{n: "0" for n in names}) == 0.0
    assert score(**ones, redundancy_penalty="1") == 6.0 and score(redundancy_penalty="1") == 0.0
    assert score("7.5") == 7.5 and score("high") == 5.0 and score(story_value="5") == 3.5 and score(story_value="x") is None


def test_voice_choice(spark):
    pick = lambda *a: tuple(one(spark, F.array(*voices.pick_voice(*[F.lit(x).cast("string") for x in a]))))
    assert pick("vi", "Nam", None) == ("Nam", "vi-VN-NamMinhNeural")
    assert pick("en", None, "en-GB-RyanNeural") == ("Nữ", "en-US-AriaNeural")
    assert pick("en", "Nam", "en-GB-RyanNeural") == ("Nam", "en-GB-RyanNeural")


# ---------------------------------------------------------------- planning
def planned(spark, duration, silences=(), cuts=(), **params):
    m = spark.createDataFrame([(1, float(duration))], "video_id long, duration_sec double")
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in silences], "video_id long, start_sec double, end_sec double")
    c = spark.createDataFrame([(1, float(t)) for t in cuts], "video_id long, t_sec double")
    got = planning.plan_chunks(m, planning.cut_points(s, c), ChunkParams(**params)).orderBy("chunk_index")
    return [(r.start_sec, r.end_sec, r.cut_reason) for r in got.collect()]


def test_plan_chunks(spark):
    assert planned(spark, 120) == [(0.0, 120.0, "final")]
    got = planned(spark, 900, [(238, 242), (478, 481), (715, 719)], tolerance_sec=30.0)
    assert [g[1:] for g in got[:2]] == [(240.0, "silence"), (479.5, "silence")]
    assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and got[-1][1] == 900.0
    assert planned(spark, 600, cuts=[250], tolerance_sec=30.0)[0][1:] == (250.0, "scene")
    assert planned(spark, 600, [(300, 301)], tolerance_sec=10.0)[0][1:] == (240.0, "hard")
    two = planned(spark, 500, tolerance_sec=5.0)
    assert len(two) == 2 and two[1][1] - two[1][0] >= 216
    long = planned(spark, 3600, [(240 * i - 1, 240 * i + 1) for i in range(1, 15)], tolerance_sec=20.0)
    assert len(long) >= 13 and {r for *_, r in long} <= {"silence", "final"}


def windows(spark, duration, cuts, **params):
    m = spark.createDataFrame([(1, float(duration))], "video_id long, duration_sec double")
    c = spark.createDataFrame([(1, float(t)) for t in cuts], "video_id long, t_sec double")
    got = planning.scene_windows(m, c, WindowParams(**params)).orderBy("w_start")
    return [(round(r.w_start, 6), round(r.w_end, 6)) for r in got.collect()]


def test_scene_windows(spark):
    assert windows(spark, 10, [], interval_sec=2.5) == [(0, 2.5), (2.5, 5), (5, 7.5), (7.5, 10)]
    assert windows(spark, 12, [4, 4.5, 8]) == [(0, 4.5), (4.5, 8), (8, 12)]           # short scene joins the one before
    assert windows(spark, 9, [1, 5]) == [(0, 5), (5, 9)]                              # a short first scene joins the second
    thirds = [round(4 + i * 8 / 3, 6) for i in range(4)]
    assert windows(spark, 12, [4]) == [(0, 4), *zip(thirds, thirds[1:])]              # a long scene is split
    assert windows(spark, 12, [4], max_frames=2) == [(0, 6), (6, 12)]


def test_sampling_grid(spark):
    m = spark.createDataFrame([(1, 60.0)], "video_id long, duration_sec double")
    g = planning.sampling_grid(m, 6.0).orderBy("grid_index").collect()
    assert [r.grid_sec for r in g] == [3.0 + 6 * i for i in range(10)] and g[0].w_start == 0 and g[-1].w_end == 60


def test_batches(spark):
    s = spark.createDataFrame([(1, i, 2.5 * i + 1.25) for i in range(20)], "video_id long, ord long, t_sec double")
    assert [r.batch for r in planning.batch_fixed(s, 8).orderBy("ord").collect()] == [i // 8 for i in range(20)]
    assert planning.sparse_pick(s).count() == 10
    w = [(0, 4), (4, 5), (5, 6), (6, 20)]
    f = spark.createDataFrame([(1, a + 0.1 * j, float(a), float(b)) for a, b in w for j in range(3)], "video_id long, t_sec double, w_start double, w_end double")
    got = planning.batch_by_scene(f, 5.0, 2).orderBy("start_sec", "end_sec").collect()
    # pieces of at most two samples, joined forward until five seconds; the last one always closes
    assert [(r.start_sec, r.end_sec, r.samples) for r in got] == [(0.0, 5.0, 5), (4.0, 20.0, 6), (6.0, 20.0, 1)]


def test_scene_cut_spacing(spark):
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate([1.0, 2.0, 2.4, 3.9, 4.0, 9.0])], "video_id long, idx long, t_sec double")
    assert sorted(r.t_sec for r in signal.spaced_times(e, 1.5).collect()) == [1.0, 3.9, 9.0]


# ---------------------------------------------------------------- highlights
@pytest.mark.parametrize("cands, budget, expected", [
    ([(0, 10, 3), (20, 30, 9), (40, 50, 7), (60, 70, 5)], 25, [(20, 30), (40, 50), (60, 65)]),
    ([(0, 10, 9), (20, 40, 8)], 25, [(0, 10), (20, 35)]),
    ([(100, 110, 9), (10, 20, 5), (50, 60, 7)], 100, [(10, 20), (50, 60), (100, 110)]),
    ([(10, 20, 9), (15, 25, 6), (30, 40, 8)], 100, [(10, 20), (30, 40)]),
    ([(0, 10, 5)], 0, []), ([(10, 10, 9), (5, 3, 8), (20, 30, 7)], 100, [(20, 30)]),
    ([(10, 12, 9), (12, 18, 9), (18, 20, 9)], 100, [(10, 12), (12, 18), (18, 20)])])
@pytest.mark.parametrize("fold_limit", [2000, 0])
def test_select_highlights(spark, cands, budget, expected, fold_limit):
    c = spark.createDataFrame([(1, i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(cands)], "video_id long, ord long, start_sec double, end_sec double, score double")
    b = spark.createDataFrame([(1, float(budget))], "video_id long, budget_sec double")
    got = highlights.select_highlights(c, b, HighlightParams(), fold_limit)
    assert sorted((r.start_sec, r.end_sec) for r in got.collect()) == expected


# ---------------------------------------------------------------- fit, placement
@pytest.mark.parametrize("actual, target, room, params, status, speed, final", [
    (3.9, 4.0, 4.0, {}, "ok", 1.0, 3.9), (5.0, 4.0, 4.0, {}, "sped_up", 1.25, 4.0), (6.0, 4.0, 5.0, {}, "overflow", 1.25, 4.8),
    (8.0, 4.0, 4.2, {}, "clipped", 1.25, 6.4), (8.0, 4.0, 4.2, {"allow_retime": True}, "needs_video_retime", 1.25, 6.4),
    (1.0, 4.0, 4.0, {}, "ok", 1.0, 1.0), (4.5, 4.0, 4.0, {"max_speedup": 1.15}, "sped_up", 1.128375, 4.5 / 1.128375)])
def test_time_fit(spark, actual, target, room, params, status, speed, final):
    c = spark.createDataFrame([(actual, target, room)], "raw_sec double, planned_sec double, available_sec double")
    r = fit.time_fit(c, FitParams(**params)).first()
    assert r.status == status and r.speed == pytest.approx(speed) and r.final_sec == pytest.approx(final)
    assert r.retime_factor == pytest.approx(6.4 / 4.2 if status == "needs_video_retime" else 1.0)


def sixty_clips(spark):
    data = [(1, i, 2.0 + 4.5 * i, 3.5, 2.0, 1.0, "ok", 280_000) for i in range(60)]
    return spark.createDataFrame(data, "video_id long, id long, start_sec double, planned_sec double, final_sec double, speed double, status string, total_ms long")


def test_placement_keeps_time(spark):
    placed = fit.place_clips(sixty_clips(spark)).collect()
    assert len(placed) == 60 and all(p.start_drift_ms == 0 and p.clipped_ms == 0 for p in placed)


@pytest.mark.parametrize("cap", [0.2, 0.4, 1.0, 2.0])
def test_pauses_do_not_accumulate(spark, cap):
    placed = fit.place_with_pauses(sixty_clips(spark), PauseParams(max_advance_sec=cap)).orderBy("id").collect()
    shrink = [p.pause_shrink_ms for p in placed]
    assert shrink[0] == 0 and all(0 <= s <= cap * 1000 for s in shrink) and len(set(shrink)) > 15
    assert abs(sum(shrink[1:16]) / 15 - sum(shrink[-15:]) / 15) < max(150, cap * 1000 / 2)
    assert all(a.placed_end_ms <= b.placed_start_ms for a, b in zip(placed, placed[1:]))


def test_pause_of_two_clips(spark):
    c = sixty_clips(spark).filter("id < 2").withColumn("start_sec", F.col("id") * 5.0)
    a, b = fit.place_with_pauses(c, PauseParams(max_advance_sec=5.0)).orderBy("id").collect()
    assert 300 <= b.placed_start_ms - a.placed_end_ms <= 1200
    still = fit.place_with_pauses(c, PauseParams(min_pause_sec=4.0, max_pause_sec=5.0, max_advance_sec=5.0)).orderBy("id").collect()
    assert still[1].pause_shrink_ms == 0


def test_parameters_are_checked():
    for bad in (lambda: FitParams(max_speedup=0.9), lambda: PauseParams(min_pause_sec=2.0), lambda: ChunkParams(target_sec=0), lambda: ScriptParams(creativity=2.0),
                lambda: WindowParams(min_scene_sec=9.0)):
        with pytest.raises(ValueError):
            bad()


# ---------------------------------------------------------------- retiming, ranges
def test_retime(spark):
    m = spark.createDataFrame([(1, 10.0), (2, 20.0)], "video_id long, duration_sec double")
    w = spark.createDataFrame([(1, 4.0, 6.0, 2.0), (2, 2.0, 4.0, 1.5), (2, 10.0, 11.0, 3.0), (2, 5.0, 6.0, 1.0)], "video_id long, start_sec double, end_sec double, factor double")
    checked = retime.check_windows(w, m)
    assert [r.reason for r in checked.filter("reason is not null").collect()] == ["not slower"]
    merged = retime.merge_windows(checked.filter("reason is null"))
    pieces = retime.partition_timeline(m, merged)
    t = spark.createDataFrame([(1, 2.0), (1, 5.0), (1, 6.0), (1, 8.0), (2, 7.0), (2, 15.0), (2, 99.0)], "video_id long, t_sec double")
    got = {(r.video_id, r.t_sec): r.new_sec for r in retime.remap(t, pieces, m).collect()}
    assert got == pytest.approx({(1, 2.0): 2, (1, 5.0): 6, (1, 6.0): 8, (1, 8.0): 10, (2, 7.0): 8, (2, 15.0): 18, (2, 99.0): 23})
    assert {r.video_id: r.new_duration_sec for r in retime.retimed_duration(m, merged).collect()} == {1: 12.0, 2: 23.0}


def test_merge_is_strict(spark):
    r = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 5.3, 6.0), (1, 6.2, 7.0)], "video_id long, start_sec double, end_sec double")
    got = ranges.merge_ranges(r, "video_id", gap=0.25).orderBy("start_sec")
    assert rows(got, "start_sec", "end_sec") == [(0.0, 5.0), (5.3, 7.0)]


def test_envelope(spark):
    s = spark.createDataFrame([(1, i, i * 0.04) for i in range(12)], "video_id long, ord long, t_sec double")
    r = spark.createDataFrame([(1, 160, 280)], "video_id long, start_ms long, end_ms long")
    got = [round(x.gain, 4) for x in mix.duck_envelope(s, r).orderBy("ord").collect()]
    assert got == [1.0, 1.0, 1.0, 0.575, 0.15, 0.15, 0.15, 0.15, 0.575, 1.0, 1.0, 1.0]


# ---------------------------------------------------------------- scripts
def test_repair_dropped_row_does_not_move_the_end(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 5.0, "a"), (1, 2, 4.0, 5.5, "b"), (1, 3, 4.9, 8.0, "c"), (1, 4, 4.9, 8.0, "copy"), (1, 5, 20.0, 20.2, "d")],
                              "video_id long, id long, start_sec double, end_sec double, text string")
    got = segments.repair_timeline(s).orderBy("id")
    assert rows(got, "id", "src_id", "start_sec", "end_sec", "text") == [(1, 1, 0.0, 5.0, "a"), (2, 3, 5.0, 8.0, "c")]


def test_script_documents(spark):
    docs = spark.createDataFrame([("a", '[{"id": 1, "start_time": "0:01", "end_time": "0:03", "text": "Hi *you*"}]'), ("b", '{"v": 1, "x": {"y": 2}, "rows": [{"start": 1, "end": 2, "text": "k"}]}'),
                                  ("c", '{"v": 1}'), ("d", "nonsense")], "source string, doc string")
    found, rejected = scripts.script_rows(docs)
    typed = segments.coerce_segments(found).orderBy("source")
    assert rows(typed, "source", "id", "start_sec", "end_sec", "text", "reason") == [("a", 1, 1.0, 3.0, "Hi you", None), ("b", 0, 1.0, 2.0, "k", None)]
    assert sorted(r.source for r in rejected.collect()) == ["c", "d"]


def test_certainty_counts(spark):
    s = spark.createDataFrame([(1, x) for x in ("observed_fact", "observed_fact", "creative_framing", "safe_inference")], "video_id long, certainty string")
    low, high = (segments.certainty_audit(s, ScriptParams(creativity=c)).first() for c in (0.1, 0.9))
    assert (low.observed_fact, low.safe_inference, low.creative_framing, low.user_provided_fact) == (2, 1, 1, 0) and low.flagged and not high.flagged


def test_assignment(spark):
    s = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 2, 8.0, 10.0), (1, 3, 14.0, 15.5), (1, 4, 50.0, 60.0)], "video_id long, id long, start_sec double, end_sec double")
    c = spark.createDataFrame([(1, 0, 0.0, 6.0), (1, 1, 6.0, 12.0), (1, 2, 12.0, 16.0)], "video_id long, chunk_index int, start_sec double, end_sec double")
    assert rows(segments.assign_to_chunks(s, c).orderBy("id"), "chunk_index", "chunk_start") == [(0, 0.0), (1, 6.0), (2, 12.0), (2, 12.0)]


# ---------------------------------------------------------------- responses
A, B = '{"id": 1, "text": "x"}', '{"id": 2, "text": "y"}'
ANSWERS = {
    "fence": (f"```json\n[{A}, {B}]\n```", "json_ok", 2), "prefix": (f"JSON\nCopy code\n[{A}]", "json_ok", 1), "stray": (f"see [note] first: [{A}]", "json_ok", 1),
    "comma": (f"[{A}, {B},]", "json_ok", 2), "smart": ("[{“id”: 1, “text”: “x”}]", "json_ok", 1), "object": (f'{{"segments": [{A}]}}', "json_ok", 1),
    "cut": (f'[{A}, {B}, {{"id": 3, "te', "truncated_json", 2), "gateway": ("<html><title>502 Bad Gateway</title><body>x</body></html>", "html_error_page", 0),
    "markup": ("<div _ngcontent-a><span>hi</span></div>", "html_dom_markup", 0), "document": ("<!DOCTYPE html><html><body>hi</body></html>", "html_page", 0),
    "tags": ("<p>a</p><b>c</b>", "html_dom_markup", 0), "server": ("Something went wrong", "server_error", 0), "quota": ("You have reached your limit", "blocked", 0),
    "login": ("Sign in to continue", "login_required", 0), "refusal": ("I can't help with that.", "refused", 0), "prose": ("A calm morning.", "prose", 0),
    "long": ("captcha " + "word " * 300, "prose", 0), "scalars": ("[1, 2, 3]", "prose", 0), "empty_list": ("[]", "prose", 0),
}


def test_response_kinds(spark):
    data = [(k, t, None, True, False, 1) for k, (t, _, _) in ANSWERS.items()]
    data += [("none", "", None, True, False, 0), ("late", "", None, True, True, 1), ("blank", " ", None, True, False, 1), ("offline", "hm", None, False, False, 1),
             ("url", "hm", "https://accounts.google.com/a", True, False, 1)]
    df = spark.createDataFrame(data, "resp_id string, text string, page_url string, online boolean, timed_out boolean, response_count int")
    got = {r.resp_id: (r.kind, len(r.records or [])) for r in responses.classify(responses.extract_payloads(df)).collect()}
    expected = {k: (kind, n) for k, (_, kind, n) in ANSWERS.items()}
    expected |= {"none": ("no_response_element", 0), "late": ("network", 0), "blank": ("empty", 0), "offline": ("network", 0), "url": ("login_required", 0)}
    assert got == expected


def test_attempts(spark):
    data = [(1, 1, "prose", True, 0), (1, 2, "json_ok", False, 3), (1, 3, "blocked", False, 0), (2, 1, "truncated_json", True, 2), (2, 2, "blocked", False, 0), (2, 3, "truncated_json", True, 1),
            (3, 1, "truncated_json", True, 2), (3, 2, "truncated_json", True, 2), (3, 3, "network", True, 0), (3, 4, "json_ok", False, 9), (4, 1, "empty", True, 0), (4, 2, "prose", True, 0)]
    df = spark.createDataFrame(data, "request_id long, attempt int, kind string, retryable boolean, n_records int")
    web = {r.request_id: (r.outcome, r.attempt) for r in responses.resolve_attempts(df, 3, "web").collect()}
    api = {r.request_id: (r.outcome, r.attempt) for r in responses.resolve_attempts(df, 3, "api").collect()}
    assert web == {1: ("success", 2), 2: ("error", 2), 3: ("partial", 1), 4: ("error", 2)}
    assert api == {1: ("success", 2), 2: ("partial", 3), 3: ("partial", 2), 4: ("error", 2)}


# ---------------------------------------------------------------- subtitles
def aligned(spark, sentences, words):
    s = spark.createDataFrame([(1, 1, 0.0, 9.0, i, t, i + 1) for i, t in enumerate(sentences)], "video_id long, id long, seg_start double, seg_end double, pos int, sentence string, sentence_no long")
    w = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(words)], "video_id long, k long, w_start double, w_end double")
    got = subtitles.align_words(s, w, ("w_start", "k")).orderBy("sentence_no").collect()
    return [(r.aligned_start, r.aligned_end) if r.accepted else None for r in got]


def test_align_words(spark):
    eight = [(0.0, 0.2), (0.3, 0.5), (0.6, 0.8), (0.8, 1.0), (1.2, 1.4), (1.5, 1.7), (1.8, 2.0), (2.0, 2.2)]
    two = ["one two three four.", "five six seven eight."]
    assert aligned(spark, two, eight) == [(0.0, 1.0), (1.2, 2.2)]
    assert aligned(spark, two, eight[:7]) == [(0.0, 1.0), (1.2, 2.0)]
    assert aligned(spark, ["a b c d e", "f g h i j"], eight[:3]) == [None, None]
    assert aligned(spark, ["a b c d", "e f g", "h i"], eight[:7]) == [(0.0, 1.0), (1.2, 2.0), (2.0, 2.0)]
    assert aligned(spark, two, []) == [None, None]


def test_cues_and_srt(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 10.0, "Hi. This is longer! "), (1, 2, 9.8, 9.9, "Tail"), (1, 3, 12.0, 13.0, "  ")], "video_id long, id long, start_sec double, end_sec double, text string")
    cues = subtitles.cue_repair(subtitles.split_cues(s)).orderBy("cue_no")
    assert [(round(r.start_sec, 3), round(r.end_sec, 3), r.text) for r in cues.collect()] == [(0.0, 1.667, "Hi."), (1.667, 9.8, "This is longer!"), (9.8, 10.3, "Tail")]
    doc = "\n".join(r.block for r in subtitles.srt_blocks(cues).orderBy("cue_no").collect())
    assert doc == "1\n00:00:00,000 --> 00:00:01,667\nHi.\n\n2\n00:00:01,667 --> 00:00:09,800\nThis is longer!\n\n3\n00:00:09,800 --> 00:00:10,300\nTail\n"


# ---------------------------------------------------------------- sources and ledger
def test_media_catalog(spark):
    probes = [(1, '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":640,"height":360,"avg_frame_rate":"30000/1001"}],"format":{"duration":"12.5"}}'),
              (2, '{"streams":[{"codec_type":"audio"}],"format":{"duration":"3"}}'), (3, '{"streams":[{"codec_type":"video","avg_frame_rate":"0/0","duration":"4"}],"format":{"duration":"N/A"}}'),
              (4, "broken"), (5, '{"streams":[{"codec_type":"video","r_frame_rate":"25"}],"format":{}}')]
    got = {r.video_id: r for r in media.media_catalog(spark.createDataFrame(probes, "video_id long, probe string")).collect()}
    assert got[1].reason is None and got[1].has_audio and got[1].fps == pytest.approx(29.97, abs=0.001) and got[1].duration_ms == 12500
    assert (got[2].reason, got[4].reason, got[5].reason) == ("no video stream", "unreadable probe", "no duration")
    assert got[3].fps == 25.0 and got[3].duration_sec == 4.0 and not got[3].has_audio


def test_silence_log(spark):
    lines = ["silence_start: -0.2", "noise", "silence_end: 1.5 | silence_duration: 1.7", "silence_end: 2 | silence_duration: 1", "silence_start: 3", "silence_start: 4",
             "silence_end: 6 | silence_duration: 2", "silence_start: 9"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "source string, line_no long, line string")
    assert sorted(rows(logs.silences_from_log(df), "start_sec", "end_sec")) == [(0.0, 1.5), (4.0, 6.0)]


@pytest.mark.parametrize("url, good", [("https://www.youtube.com/watch?v=abc", True), ("https://youtu.be/a-b?t=1", True), ("https://youtube.com/shorts/x", True), ("youtube.com/watch?v=abc", False),
                                       ("https://vimeo.com/1", False), ("", False)])
def test_urls(spark, url, good):
    assert (media.check_urls(spark.createDataFrame([(url,)], "url string")).first()["reason"] is None) == good


def test_ledger(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(3)], "video_id long, chunk_index int")
    all_stages = [(1, c, s) for c in range(3) for s in ledger.STAGES]
    book = spark.createDataFrame(all_stages, "video_id long, chunk_index int, stage string")
    cut = ledger.invalidate_from(book, spark.createDataFrame([(1, 1, ledger.STAGES[2])], "video_id long, chunk_index int, from_stage string"))
    m = ledger.status_matrix(cut, chunks)
    assert rows(m.orderBy("chunk_index"), "done", "next_stage") == [(True, None), (False, ledger.STAGES[2]), (True, None)]
    s = ledger.status_summary(m).first()
    assert (s.chunks_done, s.all_scripts_ready, s.all_speech_ready, s.first_unfinished, s.steps_complete) == (2, True, False, 1, 3)
    empty = ledger.status_matrix(book.limit(0), chunks)
    assert {r.next_stage for r in empty.collect()} == {ledger.STAGES[0]}
