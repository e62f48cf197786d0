"""Hand-made recordings with known answers, and one seeded defect per rule."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import encode, loadout, scoring, text
from tickloom.functions import vocab as V
from tickloom.operators import align, corpus, frames, quality, samples, splits, windows
from tickloom.sources import inventory, readers, sinks


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in cols.items()])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- labels and clocks -----------------------------------------------------------------


def test_labels_horizon_and_ties(spark):
    frame = spark.createDataFrame([("e", t) for t in (0, 44, 100, 101, 356, 357)], "e string, t long")
    events = spark.createDataFrame([("e", 300, 3), ("e", 300, 1), ("e", 613, 2)], "e string, t long, code int")
    out = {r["t"]: (r["label"], r["time_to"]) for r in align.label_next(frame, events, ["e"], "t", "code", 256, 6).collect()}
    assert out == {0: (6, 256), 44: (1, 256), 100: (1, 200), 101: (1, 199), 356: (6, 256), 357: (2, 256)}


def test_no_events_at_all(spark):
    frame = spark.createDataFrame([("e", 5)], "e string, t long")
    none = spark.createDataFrame([], "e string, t long, code int")
    row = align.label_next(align.since_last(frame, none, ["e"], "t", 256), none, ["e"], "t", "code", 256, 6).first()
    assert (row["since"], row["label"], row["time_to"]) == (256, 6, 256)


def test_nearest_tie_rules(spark):
    a = spark.createDataFrame([("e", 10)], "e string, t long")
    b = spark.createDataFrame([("e", 8), ("e", 12)], "e string, t long")
    pick = {tie: align.nearest_event(a, b, ["e"], "t", tie=tie).first()["nearest"]["at"] for tie in ("earlier", "later")}
    assert pick == {"earlier": 8, "later": 12}
    assert align.nearest_event(a, b, ["e"], "t", max_distance=1).first()["nearest"] is None


def test_lookup_or_zero(spark):
    a = spark.createDataFrame([("e", 10), ("x", 1)], "e string, t long")
    cache = spark.createDataFrame([("e", 9, [1.0, 2.0])], "e string, t long, v array<float>")
    out = {r["e"]: (r["found"], list(r["v"])) for r in align.lookup_or_zero(a, cache, ["e"], "t", "v", 2).collect()}
    assert out == {"e": (True, [1.0, 2.0]), "x": (False, [0.0, 0.0])}


def test_phase_order(spark):
    rows = spark.createDataFrame([(t,) for t in (0, 10, 20, 30)], "t int")
    out = [r[0] for r in rows.orderBy("t").select(encode.phase(F.col("t"), F.lit(5), F.lit(20), F.lit(30))).collect()]
    assert out == ["freeze", "live", "post_plant", "end"]


@pytest.mark.parametrize(
    "args,want",
    [(("de_mirage", -411.0, -2074.0, None, None), "a"), (("de_mirage", -1981.0, 391.0, None, None), "b"), (("de_nuke", 535.0, -1007.0, -500.0, None), "a"),
     (("de_nuke", 674.0, -757.0, -700.0, None), "b"), (("de_new", 0.0, 0.0, None, "BombsiteB"), "b"), (("de_new", 0.0, 0.0, None, None), "a")],
)
def test_site(spark, args, want):
    types = ["string", "double", "double", "double", "string"]
    assert value(spark, encode.nearest_site(*[F.lit(a).cast(t) for a, t in zip(args, types)])) == want


def test_loadout_priority(spark):
    inv = F.array(*[F.lit(x) for x in ("Knife", "Glock-18", "MP9", "AK-47", "AWP", "Flashbang", "C4 Explosive", "Desert Eagle", "Unknown")])
    held = {k: value(spark, c) for k, c in loadout.loadout(inv).items()}
    assert (held["primary"], held["secondary"], held["has_c4"], held["util_flash"], held["util_smoke"]) == ("awp", "pistol_high", 1.0, 1.0, 0.0)
    empty = {k: value(spark, c) for k, c in loadout.loadout(F.lit(None).cast("array<string>")).items()}
    assert (empty["primary"], empty["secondary"], empty["has_c4"]) == ("other", "other", 0.0)


def test_displacement_edges_close_on_the_right(spark):
    got = [value(spark, encode.displacement_class(F.lit(x), F.lit(0.0))) for x in (7.9, 8.0, 24.0, 24.1, 600.0)]
    assert got == [0, 1, 1, 17, 81]
    assert value(spark, encode.turn_bucket(F.lit(10.0), F.lit(30.0), F.lit(20.0))) == 1


# ---- repairs ---------------------------------------------------------------------------


def held(spark, rows):
    df = spark.createDataFrame(rows, "e string, f int, carried boolean, planted boolean, x double, y double")
    out = windows.hold_dropped(df, ["e"], "f", "carried", "planted", "x", "y").orderBy("f").collect()
    return [r["drop_x"] for r in out], [r["drop_y"] for r in out], sum(r["is_drop"] for r in out)


def test_hold_until_pickup(spark):
    rows = [("e", f, f <= 2 or f == 5, False, 0.25 if f <= 2 else (0.9 if f == 5 else None), -0.40 if f <= 2 else (0.9 if f == 5 else None)) for f in range(6)]
    xs, ys, drops = held(spark, rows)
    assert xs == [None, None, None, 0.25, 0.25, None] and ys[3] == -0.40 and drops == 1


def test_plant_wins(spark):
    rows = [("e", f, f <= 1, f >= 4, 0.1 if f <= 1 else None, 0.2 if f <= 1 else None) for f in range(7)]
    xs, _, drops = held(spark, rows)
    assert xs == [None, None, 0.1, 0.1, None, None, None] and drops == 1


def test_unusable_source_opens_no_interval(spark):
    xs, _, drops = held(spark, [("e", 0, True, False, float("nan"), 0.0), ("e", 1, False, False, None, None)])
    assert xs == [None, None] and drops == 0


def test_crop_and_clamp(spark):
    rows = spark.range(90).select(F.lit("e").alias("e"), F.col("id").alias("f"), F.when(F.col("id") >= 10, "end").otherwise("live").alias("phase"), (-0.2 + F.col("id") * 2.4 / 89).alias("age"))
    kept = windows.crop_tail(rows, ["e"], "f", F.col("phase") == "end", 57)
    assert kept.count() == 67
    clamp = kept.select(encode.clip01(F.col("age")).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert tuple(clamp) == (0.0, 1.0)
    assert windows.crop_tail(rows.filter("f < 10"), ["e"], "f", F.col("phase") == "end", 57).count() == 10


def test_verified_join(spark):
    meta = spark.createDataFrame([("a", 1, 100, 108, 2), ("a", 2, 999, 108, 2), ("b", 1, 1, 2, 2), ("c", 1, 1, 2, 2)], "stem string, r int, first int, last int, n int")
    side = spark.createDataFrame([("a", 1, 100, 108, 2), ("a", 2, 100, 108, 2), ("c", 1, 1, 2, 2)], "stem string, r int, first int, last int, n int")
    stems = spark.createDataFrame([("a", True), ("c", False)], "stem string, complete boolean")
    out = corpus.verified_join(meta, side, ["stem", "r"], ["first", "last", "n"], stems, "stem", "complete").select("stem", "r", "status").collect()
    assert {(r[0], r[1]): r[2] for r in out} == {("a", 1): "verified", ("a", 2): "source_key_mismatch", ("b", 1): "source_unavailable", ("c", 1): "source_columns_missing"}


def test_exclusions_win_over_keep(spark):
    rows = spark.createDataFrame([(m,) for m in ("de_mirage", "de_anubis", "de_dust2", "de_train", "de_nuke")], "map_name string")
    assert corpus.drop_maps(rows, "map_name", V.DEFECT_MAPS).count() == 3
    assert corpus.drop_maps(rows, "map_name", V.DEFECT_MAPS, keep=["de_train", "de_nuke"]).count() == 1
    assert corpus.drop_maps(rows, "map_name", V.DEFECT_MAPS, clean=False).count() == 5


# ---- the small recording ---------------------------------------------------------------


@pytest.fixture(scope="module")
def recording(spark):
    players = [(sid, "t") for sid in range(10, 15)] + [(sid, "ct") for sid in range(20, 25)]
    rows = [("m", 1, t, sid, f"p{sid}", side, 300.0 * (sid % 10), 30.0, 5.0, 90.0, 0.0, 100, 50, 800, 1000, True, False, ["C4 Explosive"] if sid == 12 and t < 108 else ["AK-47"])
            for t in (100, 104, 108, 112) for sid, side in players if not (sid == 24 and t == 108)]
    ticks = spark.createDataFrame(rows, "demo_stem string, round_num int, tick int, steamid long, name string, side string, X double, Y double, Z double, yaw double, pitch double, health int, armor int, balance int, current_equip_value int, has_helmet boolean, has_defuser boolean, inventory array<string>")
    kills = spark.createDataFrame([("m", 1, 106, None)], "demo_stem string, round_num int, tick int, attacker_side string")
    bomb = spark.createDataFrame([("m", 1, 108, "plant", -411.0, -2074.0, None, "BombsiteB")], "demo_stem string, round_num int, tick int, event string, X double, Y double, Z double, bombsite string")
    rounds = spark.createDataFrame([("m", 1, 102, 200, None, 108, "t", "bomb_exploded"), ("m", 0, 1, 2, None, None, "ct", "x")], "demo_stem string, round_num int, freeze_end int, `end` int, official_end int, bomb_plant int, winner string, reason string")
    header = spark.createDataFrame([("m", "de_mirage")], "demo_stem string, map_name string")
    return frames.build(ticks, kills, bomb, rounds, header, 2), ticks, rounds, header


def test_frames(spark, recording):
    (players, glob, grid), _, rounds, header = recording
    got = {r["tick"]: r for r in glob.collect()}
    assert sorted(got) == [100, 108]
    a, b = got[100], got[108]
    assert (a["phase"], b["phase"]) == ("freeze", "post_plant")
    assert (a["bomb_state"], b["bomb_state"]) == ("carried", "planted_a")
    assert (a["score_t"], a["score_ct"]) == (0, 0)  # round 0 has no rows, so it does not score
    assert a["event_label"] == V.EVENTS.index("bomb_planted") and a["event_time"] == 8  # the kill has no attacker side
    assert (b["event_label"], b["event_time"]) == (V.EVENTS.index("bomb_planted"), 0)
    assert (a["since_kill"], b["since_kill"], b["since_event"]) == (256, 2, 0)
    assert b["round_time"] == pytest.approx(6 / 64 / 115)
    p = {(r["tick"], r["slot"]): r for r in players.collect()}
    assert len(p) == 20 and p[(100, 0)]["steamid"] == 10 and p[(100, 9)]["steamid"] == 24
    assert not p[(108, 9)]["is_present"] and p[(108, 9)]["cos_yaw"] == 0.0
    assert p[(100, 2)]["has_c4"] == 1.0 and p[(108, 2)]["has_c4"] == 0.0
    meta = frames.episodes(grid, rounds, header, 2).first()
    assert (meta["n_ticks"], meta["first_tick"], meta["last_tick"], meta["map_name"]) == (2, 100, 108, "de_mirage")


def test_null_fill_and_widths(spark, recording):
    (players, glob, grid), ticks, *_ = recording
    filled = frames.player_frames(ticks, grid, fill="nulls").filter("NOT is_present").first()
    assert (filled["cos_yaw"], filled["cos_pitch"], filled["x"]) == (1.0, 1.0, 0.0)
    assert frames.feature_table(players, glob).select(F.size("features")).distinct().collect()[0][0] == 597


TOY = [  # phase, clock, bits set, carried, planted, has c4, x
    (0, "freeze", 0.0, 1, True, False, True, 0.0), (1, "freeze", 0.0, 1, True, False, True, 0.0), (2, "live", 0.1, 1, True, False, True, 0.0),
    (3, "live", 0.3, 1, True, False, True, 0.0), (4, "post_plant", 0.6, 1, False, True, False, 0.3), (5, "end", 0.9, 1, False, True, False, 0.3),
]
def rules():
    return {
        "no state": F.col("hot") == 0,
        "several states": F.col("hot") > 1,
        "carried without bomb": F.col("carried") & ~F.col("c4"),
        "bomb without state": F.col("c4") & ~(F.col("carried") | F.col("planted")),
        "planted nowhere": F.col("planted") & (F.col("x") == 0),
        "planted too early": F.col("planted") & ~F.col("phase").isin("post_plant", "end"),
        "clock in freeze": (F.col("phase") == "freeze") & (F.abs("clock") > 1e-6),
        "clock range": (F.col("clock") < 0) | (F.col("clock") > 2),
        "not finite": F.isnan("clock") | F.isnan("x"),
    }


def toy(spark, **changes):
    names = "f int, phase string, clock double, hot int, carried boolean, planted boolean, c4 boolean, x double"
    df = spark.createDataFrame(TOY, names).withColumn("e", F.lit(1))
    for c, (frame, v) in changes.items():
        df = df.withColumn(c, F.when(F.col("f") == frame, F.lit(v)).otherwise(F.col(c)))
    return quality.invariant_report(df, rules(), ["e"], ["e", "f"])


def test_clean_recording_passes(spark):
    assert toy(spark).count() == 0
    quality.require_clean(toy(spark))


@pytest.mark.parametrize(
    "rule,change",
    [("no state", {"hot": (2, 0)}), ("several states", {"hot": (2, 2)}), ("carried without bomb", {"c4": (2, False)}), ("bomb without state", {"carried": (2, False)}),
     ("planted nowhere", {"x": (4, 0.0)}), ("planted too early", {"phase": (4, "live")}), ("clock in freeze", {"clock": (1, 1.2)}), ("clock range", {"clock": (5, 2.5)}), ("not finite", {"clock": (3, float("nan"))})],
)
def test_every_rule_fires(spark, rule, change):
    found = {r["rule"]: r for r in toy(spark, **change).collect()}
    assert rule in found and found[rule]["bad_rows"] == 1 and found[rule]["first"]["f"] == next(iter(change.values()))[0]
    with pytest.raises(ValueError, match=rule):
        quality.require_clean(toy(spark, **change))


def test_scope_guards(spark):
    eps = spark.createDataFrame([("de_mirage", "v2"), ("de_dust2", "v2")], "map_name string, version string")
    quality.require_single(eps, "version", "versions")
    quality.require_scope(eps, "map_name", ["de_mirage", "de_dust2"], 2)
    with pytest.raises(ValueError, match="expected 3"):
        quality.require_scope(eps, "map_name", ["de_mirage", "de_dust2"], 3)
    with pytest.raises(ValueError, match="held-out"):
        quality.require_scope(eps, "map_name", ["de_mirage", "de_dust2"], 2, held_out=["de_dust2"])
    with pytest.raises(ValueError, match="mixed"):
        quality.require_single(eps.withColumn("version", F.col("map_name")), "version", "versions")


# ---- text and scores -------------------------------------------------------------------


@pytest.mark.parametrize(
    "reply,want",
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("none", None), ('{"a": ', None), ('```{"a" 1}``` {"b": 3}', None)],
)
def test_json_object(spark, reply, want):
    assert value(spark, text.json_object(F.lit(reply))) == want


def test_format_gate(spark):
    assert value(spark, text.format_gate(F.lit('{"game_state": {}, "analysis": {}, "advice": {}}'))) == 1.0
    assert value(spark, text.format_gate(F.lit('{"game_state": {}, "analysis": [], "advice": {}}'))) == 0.0
    assert value(spark, text.format_gate(F.lit('{"game_state": {}}'), sections=("game_state",))) == 1.0


def test_behaviour_reads_only_what_is_said(spark):
    df = spark.createDataFrame([("Push the site with a smoke",), ("hello",)], "t string")
    a, b = [r["b"] for r in text.with_behaviour(df, "t", "b").collect()]
    assert (a["movement_direction"], a["objective_direction"], a["utility_used"], a["initiated_engagement"], a["engagement_delay"]) == (1, 1, ["smoke"], True, 0.2)
    assert (b["movement_direction"], b["initiated_engagement"], b["utility_used"]) == (None, None, [])


def test_trigrams(spark):
    assert value(spark, text.trigrams(F.lit("ab"))) == ["ab"]
    assert sorted(value(spark, text.trigrams(F.lit("aaaé😀b")))) == sorted(["aaa", "aaé", "aé😀", "é😀b"])
    empty = text.trigrams(F.lit(""))
    assert value(spark, text.jaccard(empty, empty)) == 1.0


def test_numeric_score(spark):
    def s(p, t):
        return value(spark, scoring.numeric(F.lit(p).cast("double"), F.lit(t).cast("double")))

    assert (s(109, 100), s(0, 0), s(1, 0), s(None, None), s(None, 5), s(130, 100)) == (1.0, 1.0, 0.0, 1.0, 0.0, 0.0)
    assert s(115, 100) == pytest.approx(0.5)


def test_outcome_matrix(spark):
    def omega(w, a):
        return round(value(spark, scoring.modulation(F.lit(w), F.lit(1.0), F.lit(a))), 6)

    assert (omega(True, 1.0), omega(False, 1.0), omega(True, 0.0), omega(False, 0.0)) == (1.0, 0.2, 0.5, 0.5)
    assert value(spark, scoring.contribution(*[F.lit(None).cast("double")] * 4, F.lit(None).cast("boolean"))) == 0.5


def test_reward_registry(spark):
    r = scoring.RewardRegistry()
    r.register("x", lambda c: c, 0.2)
    r.register("y", lambda c: 1 - c, 0.8)
    assert value(spark, r.total(F.lit(1.0), F.lit(0.5))) == pytest.approx(0.5)
    assert value(spark, r.total(F.lit(0.0), F.lit(0.5))) == 0.0


def test_canonical_names(spark):
    assert value(spark, text.unordered_pair(F.lit("vitality-vs-natus-vincere-m2-anubis"))) == "natus-vincere-vs-vitality-m2-anubis"
    assert value(spark, text.team_key(F.lit("aurora-vs-furia-m2-inferno"))) == "aurora-vs-furia"
    assert value(spark, text.unordered_pair(F.lit("plain"))) == "plain"


def test_opening_snapshot(spark):
    states = spark.createDataFrame([("e", 1, "a"), ("e", 5, "b"), ("g", 2, "c")], "k string, t int, v string")
    anchors = spark.createDataFrame([("e", 4), ("g", 9)], "k string, f int")
    out = {r["k"]: r["snapshot"]["v"] for r in samples.opening_snapshot(states, anchors, ["k"], "t", "f", ["v"]).collect()}
    assert out == {"e": "b", "g": "c"}


def test_splits_keep_groups_whole(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("g"), (F.col("id") % 37 % 4).alias("s"))
    marked = splits.stratified_group_split(rows, "g", "s", 0.2, [0, 1, 2, 3], seed=1)
    assert marked.count() == 1000 and marked.select("g", "split").distinct().count() == 37
    small, large = (splits.nested_subset(rows, "g", n).select("g").distinct() for n in (5, 12))
    assert small.count() == 5 and large.count() == 12 and small.subtract(large).count() == 0


# ---- files -----------------------------------------------------------------------------


def test_manifest_last_row_wins(spark, tmp_path):
    lines = ['{"id": "a", "seq": 1, "tags": ["x"]}', "", "{broken", '{"id": "a", "seq": 2, "tags": ["y"]}', '{"id": "b", "seq": 3}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_manifest(spark, str(tmp_path), "id string, seq int, tags array<string>")
    assert {r["id"]: r["seq"] for r in good.collect()} == {"a": 2, "b": 3} and bad.count() == 1
    assert corpus.match_fields(good, tags="y").count() == 1 and corpus.match_fields(good, tags=["x", "q"]).count() == 0
    assert corpus.match_fields(good, nothing=1).count() == 0
    sinks.append_lines(good, str(tmp_path / "out"))
    sinks.append_lines(good, str(tmp_path / "out"))
    assert readers.read_lines(spark, str(tmp_path / "out"), "id string, seq int").count() == 4


def test_event_lists(spark, tmp_path):
    (tmp_path / "m1_kills.json").write_text(json.dumps([{"round_num": 1, "tick": 5, "attacker_side": "t"}]))
    (tmp_path / "m2_kills.json").write_text("[]")
    assert [r["demo_stem"] for r in readers.read_events(spark, str(tmp_path), "kills").collect()] == ["m1"]
    empty = readers.read_events(spark, str(tmp_path), "damages")
    assert empty.count() == 0 and "dmg_health_real" in empty.columns


@pytest.mark.parametrize("alike", [False, True])
def test_large_recordings_are_written_in_parts(spark, tmp_path, monkeypatch, alike):
    monkeypatch.setattr(sinks, "PART_RECORDS", 100, raising=False)
    monkeypatch.setattr(sinks, "PART_ROWS", 100, raising=False)
    rows = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("m_"), F.col("id") % 3)).otherwise("hot").alias("stem"), (F.lit(7) if alike else F.col("id")).cast("int").alias("tick"))
    want = sorted((r["stem"], r["n"]) for r in rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).collect())
    sinks.write_arrays(rows, str(tmp_path), "stem", "kills")
    assert max(len(json.loads(f.read_text())) for f in tmp_path.glob("*_kills.json")) < 200  # on average at most 100
    read = readers.read_events(spark, str(tmp_path), "kills")
    assert sorted((r["demo_stem"], r["n"]) for r in read.groupBy("demo_stem").agg(F.count(F.lit(1)).alias("n")).collect()) == want
    assert read.filter("tick IS NULL").isEmpty()
    sinks.write_recordings(rows, str(tmp_path), "stem", "ticks")
    assert len(list(tmp_path.glob("hot*_ticks.parquet"))) > 1
    read = readers.read_ticks(spark, f"{tmp_path}/*_ticks.parquet", ["tick"])
    assert sorted((r["demo_stem"], r["n"]) for r in read.groupBy("demo_stem").agg(F.count(F.lit(1)).alias("n")).collect()) == want


def test_tick_scan_prunes(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3)], "round_num int, tick int, steamid long").coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("part-*.parquet"))
    (tmp_path / "m7_ticks.parquet").write_bytes(part.read_bytes())
    df = readers.read_ticks(spark, str(tmp_path / "*_ticks.parquet"), ["tick"])
    assert tuple(df.first()) == ("m7", 2)
    assert "steamid" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_label_files_and_inventory(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.json").write_text('{"x": 1}')
    (tmp_path / "c1" / "b.json").write_text("{oops")
    for n in ("a.png", "c.JPG", "d.txt", "e.webp"):
        (tmp_path / "c1" / n).write_bytes(b"123")
    good, bad = readers.read_label_files(spark, str(tmp_path), "x int")
    row = good.first()
    assert (row["stem"], row["parent"], row["x"]) == ("a", "c1", 1) and bad.count() == 1
    files = inventory.list_files(spark, str(tmp_path), ["png", "webp"], with_sha=True)
    assert files.count() == 2
    stats = inventory.label_stats(files, good).first()
    assert (stats["total"], stats["labeled"], stats["unlabeled"]) == (2, 1, 1)
    assert inventory.labelled(files, good).count() == 1 and inventory.unlabelled(files, good).first()["stem"] == "e"
    manifest = files.select("name", "sha256", "bytes").filter("name = 'a.png'")
    assert {r["name"]: r["status"] for r in quality.integrity(files, manifest).collect()} == {"a.png": "OK", "e.webp": "NO ENTRY"}
    assert inventory.folder_sizes(files).count() == 2


def test_writers_refuse_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "m"), (2, "val", "m")], "id int, split string, map_name string")
    path = str(tmp_path / "f")
    sinks.write_frames(rows, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_frames(rows, path)
    assert "PartitionFilters: [isnotnull" in spark.read.parquet(path).filter("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    done = str(tmp_path / "done")
    rows.filter("id = 1").write.parquet(done)
    sinks.append_missing(rows, spark.read.parquet(done), ["id"], done)
    assert spark.read.parquet(done).count() == 2


def test_nothing_is_published_when_the_check_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "m")], "id int, split string, map_name string")

    def refuse(_):
        raise ValueError("dirty")

    with pytest.raises(ValueError):
        sinks.publish_clean(rows, str(tmp_path / "s"), str(tmp_path / "p"), refuse)
    assert not (tmp_path / "p").exists()
    sinks.publish_clean(rows, str(tmp_path / "s"), str(tmp_path / "p"), lambda df: None)
    doc = sinks.schema_document(spark.read.parquet(str(tmp_path / "p")), "v1", {"maps": V.MAPS}).first()
    assert doc["version"] == "v1" and len(doc["vocabularies"]["maps"]) == 7


def test_indexed_join_refuses(spark):
    a, b = spark.range(3).withColumnRenamed("id", "i"), spark.range(4).withColumnRenamed("id", "i")
    assert corpus.indexed_join(a, a, "i").count() == 3
    with pytest.raises(ValueError):
        corpus.indexed_join(a, b, "i")


def test_digest_ignores_order(spark):
    a = spark.range(50)
    assert quality.table_digest(a).first() == quality.table_digest(a.orderBy(F.col("id").desc())).first() != quality.table_digest(spark.range(49)).first()


def test_label_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{")
    for table in readers.read_label_files(spark, str(tmp_path), "x int"):
        assert table.count() == 1 and "FileScan text" not in table._jdf.queryExecution().executedPlan().toString()


def test_trigrams_list_their_characters_once(spark):
    plan = spark.range(1).select(text.trigrams(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert value(spark, text.trigrams(F.lit("a\r\n\x00b"))) == ["a\r\n", "\r\n\x00", "\n\x00b"]
    assert value(spark, text.trigrams(F.lit(None).cast("string"))) == []


def test_recordings_are_named_without_a_formatter(spark):
    from tickloom.plans import recordings

    rows = spark.createDataFrame([(0,), (6399,), (None,)], "k long")
    named = rows.select(*recordings.keyed("k"))
    assert {tuple(r) for r in named.collect()} == {("rec0", 0), ("rec19", 19), ("recnull", None)}
    assert "format_string" not in named._jdf.queryExecution().optimizedPlan().toString()
