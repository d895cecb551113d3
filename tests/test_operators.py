import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from roadsky.operators import clean, dictionary, fill, impact, profile, sample
from roadsky.schemas import INCIDENT_COLUMNS


def stamp(minutes, offset="-04:00"):
    return f"2020-01-{1 + minutes // 1440:02d}T{minutes % 1440 // 60:02d}:{minutes % 60:02d}:00.000{offset}"


@pytest.fixture
def raw(spark):
    rows = [
        ("ok", stamp(0), stamp(30), "Fast", "Fair", "1", "10.5"),
        ("equal", stamp(5), stamp(5), "Fast", "Fair", "1", "1"),
        ("before", stamp(30), stamp(0), "Fast", "Fair", "1", "1"),
        ("day", stamp(0), stamp(1440), "SLOW", "Light Rain ", "2", "NaN"),
        ("over", stamp(0), stamp(1441), "Slow", "Fog", "2", "1"),
        ("bad time", "soon", stamp(10), "Slow", "Fog", "2", "1"),
        ("offsets", stamp(0), stamp(10, "-05:00"), None, "fair", "x", "1"),
        ("no words", stamp(0), stamp(20), "crawl", None, "3", None),
    ]
    return spark.createDataFrame(
        rows, ["ID", "StartTime", "EndTime", "Congestion_Speed", "Weather_Conditions", "Severity", "Distance(mi)"]
    )


def test_clean_exact(raw):
    rows = {row.ID: row for row in clean.clean_exact(raw).collect()}
    assert set(rows) == {"ok", "day", "offsets", "no words"}
    assert rows["day"]["TrafficJamDuration(mins)"] == 1440 and rows["offsets"]["TrafficJamDuration(mins)"] == 70
    assert [rows[k].SpeedNumeric for k in ("ok", "day", "offsets", "no words")] == [60, 20, None, None]
    flags = {k: (r.GoodWeather, r.BadWeather, r.NeutralWeather) for k, r in rows.items()}
    assert flags == {"ok": (1, 0, 0), "day": (0, 1, 0), "offsets": (0, 0, 0), "no words": (0, 0, 0)}


def test_clean_substring(raw):
    rows = {row.ID: row for row in clean.clean_substring(raw).collect()}
    assert rows["offsets"].weather_rating == "good" and rows["no words"].weather_rating == "unknown"
    assert (rows["ok"].weather_good, rows["ok"].weather_bad, rows["ok"].weather_unknown) == (1, 0, 0)
    assert rows["no words"].speed_category == "Unknown" and rows["no words"].speed_numeric is None


def test_model_frame_drops_null_nan_and_text(raw):
    frame = clean.model_frame(raw, ["Severity"], ["Distance(mi)"])
    assert sorted(map(tuple, frame.collect())) == [(1.0, 1.0), (1.0, 1.0), (1.0, 10.5), (2.0, 1.0), (2.0, 1.0)]
    with pytest.raises(ValueError, match="missing columns"):
        clean.model_frame(raw, ["Absent"], [])


def test_costly_columns_are_computed_once(raw):
    plan = clean.clean_exact(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 2


def test_small_cleaning_helpers(raw):
    assert clean.ensure_columns(raw, ["ID", "zero"]).columns[-1] == "zero"
    assert "StartTime" not in clean.renamed(raw, {"ID": "id"}, drop=["StartTime"]).columns
    assert "WeatherConditions" in clean.without_underscores(raw).columns
    timed = clean.with_duration(clean.with_times(raw, "StartTime", "EndTime"))
    assert tuple(clean.duration_counts(timed).first()) == (8, 4)
    assert clean.complete_rows(raw, ["Congestion_Speed"]).count() == 7
    assert clean.not_null_rows(raw, "Weather_Conditions", "Distance(mi)").count() == 7


# ---- fills -----------------------------------------------------------------


def brute_fill(rows, method):
    """rows: (group, time, id, value)"""
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    result = {}
    for series in groups.values():
        values = [row[3] for row in series]
        for i, row in enumerate(series):
            known = [v for v in values[: i + 1] if v is not None]
            ahead = [v for v in values[i:] if v is not None]
            last, first, following = known[-1:], known[:1], ahead[:1]
            found = {
                "forward": last,
                "backward": following,
                "forward_then_backward": last or following,
                "first_seen": [row[3]] if row[3] is not None else first,
            }[method]
            result[row[2]] = found[0] if found else None
    return result


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(12)}"
        value = rng.choice(["a", "b", "c"]) if rng.random() < 0.3 else None
        rows.append((group, rng.randrange(60), i, value))
    rows += [("empty", t, 1000 + t, None) for t in range(5)]
    return rows, spark.createDataFrame(rows, "g string, t int, id int, v string").repartition(5)


@pytest.mark.parametrize("method", fill.METHODS)
@pytest.mark.parametrize("ranges", [None, 1, 23])
def test_fills_match_brute_force(series, method, ranges):
    rows, df = series
    filled = fill.fill_missing(df, ["v"], ["g"], "t", ["id"], method, ranges)
    assert filled.columns == df.columns
    found = [(row.id, row.v) for row in filled.collect()]
    assert len(found) == len(rows) and dict(found) == brute_fill(rows, method)


@pytest.mark.parametrize("method", fill.METHODS)
def test_rows_of_a_fill_are_dealt_once(series, method):
    """The ranges are filled where they were made: what is read back needs no exchange but that of the small carry."""
    filled = fill.fill_missing(series[1], ["v"], ["g"], "t", ["id"], method)
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    around = [line for line in plan.splitlines() if "Window" in line]
    assert around and all("_range" in line and "_head_" in line or "_tail_" in line or "_from_" in line for line in around)
    assert not any("_row_hash" in line for line in around)


def test_fills_over_many_batches(spark):
    """Groups that go on over Arrow batches, and groups of NaN and null."""
    rows = [(g, i, "a" if i % 7 == 3 else None) for g in (1.0, float("nan"), None) for i in range(40)]
    df = spark.createDataFrame(rows, "g double, t int, v string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        for method, missing in (("forward", 9), ("first_seen", 9), ("backward", 3 * 1), ("forward_then_backward", 0)):
            found = fill.fill_missing(df, ["v"], ["g"], "t", [], method, 1).collect()
            assert len(found) == 120 and sum(r.v is None for r in found) == missing, method
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_fill_knows_its_methods(series):
    with pytest.raises(ValueError, match="method"):
        fill.fill_missing(series[1], ["v"], ["g"], "t", ["id"], "sideways")


@pytest.mark.parametrize("method", fill.METHODS)
def test_ties_do_not_depend_on_partitions(spark, method):
    """Equal times without a tie column: the same rows for any partitions and ranges, told by the order of the row hash."""
    rng = random.Random(4)
    pick = lambda: rng.choice(["a", "b", "c", None, None])
    rows = [(f"g{rng.randrange(3)}", rng.randrange(4), pick(), pick(), i) for i in range(120)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "g string, t int, v string, w string, x int")
    results = [
        sorted(map(tuple, fill.fill_missing(frame.repartition(p), ["v", "w"], ["g"], "t", [], method, r).collect()), key=str)
        for p, r in ((3, None), (7, 1), (5, 29))
    ]
    assert results[0] == results[1] == results[2]
    # both columns follow one order of the rows
    whole = [F.col(c) for c in frame.columns]
    keyed = frame.withColumns({"h": F.xxhash64(*whole), "k": F.hash(*whole)}).collect()
    expected = []
    for column in (2, 3):
        plain = [(r["g"], (r["t"], r["h"], r["k"]), i, r[column]) for i, r in enumerate(keyed)]
        expected.append(brute_fill(plain, method))
    told = [(r["g"], r["t"], expected[0][i], expected[1][i], r["x"]) for i, r in enumerate(keyed)]
    assert results[0] == sorted(told, key=str)


def test_rows_that_share_a_key_stay(spark):
    rows = [("x", 1, 7, "a"), ("x", 1, 7, None), ("x", 1, 7, None), (None, 2, 8, None), (None, 1, 9, "n")]
    df = spark.createDataFrame(rows, "g string, t int, id int, v string")
    for ranges in (None, 3):
        filled = fill.fill_missing(df, ["v"], ["g"], "t", ["id"], "forward_then_backward", ranges)
        assert sorted(row.v for row in filled.collect()) == ["a", "a", "a", "n", "n"]


def test_fill_several_columns(spark):
    rows = [("x", 1, "a", None), ("x", 2, None, 5), ("x", 3, None, None), ("x", 4, "d", 6)]
    df = spark.createDataFrame(rows, "g string, t int, v string, w int")
    for ranges in (None, 3):
        filled = fill.fill_missing(df, ["v", "w"], ["g"], "t", [], "forward", ranges)
        found = sorted((row.t, row.v, row.w) for row in filled.collect())
        assert found == [(1, "a", None), (2, "a", 5), (3, "a", 5), (4, "d", 6)]


# ---- samples ---------------------------------------------------------------


@pytest.mark.parametrize("fraction", [0.0, 0.005, 0.1, 0.999, 1.0])
def test_sample_has_exact_size_and_repeats(spark, fraction):
    df = spark.range(3000).withColumn("x", F.col("id") * 2)
    first = sample.sample_exact(df, fraction, ["id"], seed=3)
    again = sample.sample_exact(df.repartition(7), fraction, ["id"], seed=3)
    kept = sorted(map(tuple, first.collect()))
    assert len(kept) == int(3000 * fraction) and len(set(kept)) == len(kept)
    assert kept == sorted(map(tuple, again.collect()))


def test_sample_splits_a_group_of_copies(spark):
    df = spark.createDataFrame([("same", None)] * 500 + [(f"r{i}", i) for i in range(100)], "a string, b int")
    for fraction in (0.1, 0.5, 0.9):
        kept = [row.a for row in sample.sample_exact(df, fraction).collect()]
        assert len(kept) == int(600 * fraction)
        others = [a for a in kept if a != "same"]
        assert len(others) == len(set(others))
    assert sample.sample_exact(df.limit(0), 0.5).count() == 0


def test_sample_narrows_a_hot_key(spark):
    """One key on most rows, each row different: the edge is narrowed level by level."""
    df = spark.range(4000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id", F.lit(None).alias("z"))
    wide = sample.sample_exact(df, 0.4, ["k"], seed=1)
    deep = sample.sample_exact(df.repartition(6), 0.4, ["k"], seed=1, edge_rows=5)
    kept = sorted(row.id for row in wide.collect())
    assert len(set(kept)) == 1600 and kept == sorted(row.id for row in deep.collect())


def test_splits(spark):
    df = spark.range(4000)
    split = sample.with_split(df, ["id"], 0.7)
    train = split.filter("split = 'train'").count()
    assert 2650 < train < 2950 and split.count() == 4000
    left, right = sample.split_random(df, 0.7, seed=1)
    assert left.count() + right.count() == 4000
    assert 300 < sample.sample_approximate(df, 0.1, seed=1).count() < 500


# ---- profiles and impact ---------------------------------------------------


def test_profile(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", " ", "", None, f"u{i}"]), rng.choice([1.5, 2.0, float("nan"), None])) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, d double")
    missing = {row.Column: row.Missing_Percentage for row in profile.missing_share(df).collect()}
    present = {
        "s": [s for s, _ in rows if s is not None and s.strip()],
        "d": [str(d) for _, d in rows if d is not None and d == d],
    }
    for name, values in present.items():
        assert missing[name] == pytest.approx(100 * (1 - len(values) / 500))
        best = sorted(Counter(values).items(), key=lambda item: (-item[1], item[0]))[:5]
        top = profile.top_values(df, top_n=5).filter(F.col("Column") == name).orderBy("rank").collect()
        assert [(row.Value, row.Count) for row in top] == best
        assert top[0].Percentage == pytest.approx(100 * best[0][1] / len(values))


def test_top_values_limits_before_the_exchange(spark):
    top = profile.top_values(spark.createDataFrame([("a", 1)], "s string, i int"), top_n=3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_describe(spark):
    df = spark.createDataFrame([(1.0, 4), (3.0, None)], "x double, n int")
    rows = {row["column"]: row for row in profile.describe_columns(df, ["x", "n"]).collect()}
    assert rows["x"]["count"] == 2 and rows["x"].mean == 2 and rows["x"].stddev == pytest.approx(2**0.5)
    assert rows["n"]["count"] == 1 and rows["n"].stddev is None and rows["n"]["max"] == 4


def test_impact_and_crosstab(spark):
    rows = [
        ("Fair", "Fast", "1", "2"), ("fair day", "Slow 10 mph", "3", "x"), ("Rain", "Fast", None, "4"),
        ("Rain", None, "2", "4"), (None, "Moderate", "9", "9"),
    ]
    df = spark.createDataFrame(
        rows, ["Weather_Conditions", "Congestion_Speed", impact.DELAY_TYPICAL, impact.DELAY_FREE_FLOW]
    )
    found = {row.weather_rating: tuple(row)[1:] for row in impact.impact_by_rating(df).collect()}
    assert found == {
        "good": (2, 10.0, 2.0, 2.0, 50.0, 0.0, 50.0, 40.0),
        "bad": (2, None, 2.0, 4.0, 50.0, 0.0, 0.0, 40.0),
        "unknown": (1, None, 9.0, 9.0, 0.0, 100.0, 0.0, 20.0),
    }
    folded = impact.crosstab_share(impact.incidents_by_text(df), count="rows")
    plain = impact.crosstab_share(impact.with_impact_columns(df))
    shares = {row.weather_rating: tuple(row)[1:] for row in folded.collect()}
    assert shares == {row.weather_rating: tuple(row)[1:] for row in plain.collect()}
    assert shares["bad"] == (50.0, 0.0, 0.0, 50.0)


def test_schema_names():
    assert len(INCIDENT_COLUMNS) == 30 and INCIDENT_COLUMNS[0] == "ID"


def test_sampling_has_no_task_for_all_rows(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    plan = sample.sample_exact(df, 0.3, ["x"], seed=2)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Sort" not in plan.replace("SortAggregate", "").replace("Sort [_hash", "")


@pytest.mark.parametrize("wanted", [0, 1, 7, 500, 999, 1000])
@pytest.mark.parametrize("edge_rows", [1, 10_000])
def test_selection_by_counting(spark, wanted, edge_rows):
    texts = sorted([f"{i * i * 7919 % 16**6:06x}" for i in range(700)] + ["0f0f0f"] * 300)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    edge = sample.smallest(rows, "t", lambda n: wanted, edge_rows)
    if not wanted:
        assert edge is None
        return
    taken = [t for t in texts if t[: len(edge.bound)] < edge.bound]
    equal = [t for t in texts if t.startswith(edge.bound)]
    taken += equal if edge.left is None else equal[: edge.left]
    assert taken == texts[:wanted]


# ---- dictionaries ------------------------------------------------------------


def test_ratings_by_entries_of_a_table(spark):

    r = random.Random(4)
    entries = [("".join(r.choice("abcé") for _ in range(r.randint(1, 5))), r.choice(["good", "bad", "neutral", "other"])) for _ in range(150)]
    entries += [("", "good"), (None, "good"), ("SNOW", "bad"), ("snow", "good")]
    texts = [None, "", "  ", "SnOw fall"] + ["".join(r.choice("abcéxyz ") for _ in range(r.randint(1, 12))) for _ in range(300)]
    table = spark.createDataFrame(entries, "entry string, rating string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("rating", F.lit("old"))
    order = ["bad", "good", "neutral"]
    found = {row.id: row.rating for row in dictionary.rating_from_entries(df, "text", table, order, "rating").collect()}
    for i, text in enumerate(texts):
        hits = [order.index(k) for e, k in entries if e and k in order and text and text.strip() and e.lower() in text.lower()]
        assert found[i] == (order[min(hits)] if hits else "unknown")
    none = dictionary.rating_from_entries(df, "text", table.limit(0), order, "rating")
    assert {row.rating for row in none.collect()} == {"unknown"}


def test_a_dictionary_too_large_to_ship_is_refused(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_ENTRIES", 3)
    table = spark.createDataFrame([(f"w{i}", "good") for i in range(5)], "entry string, rating string")
    with pytest.raises(ValueError, match="too large"):
        dictionary.entries_of(table, ["good"])


@pytest.mark.parametrize("same", [False, True])
def test_best_places_down_the_tree(monkeypatch, same):
    monkeypatch.setattr(dictionary, "POSITIONS", 7)
    if same:  # mixes that are equal, until they get a salt
        mix = dictionary.Steps.mix
        monkeypatch.setattr(dictionary.Steps, "mix", lambda self, nodes, words: mix(self, nodes, words) if self.salt else words & np.uint64(1))
    r = random.Random(9)
    base = ["".join(r.choice("ab\0é€") for _ in range(r.randint(1, 40))) for _ in range(60)]
    entries = list(dict.fromkeys(base + [x[: r.randint(1, len(x))] + y[: r.randint(0, 9)] for x in base for y in base[:6]]))
    entries = [x for x in entries if len(x) > 2]
    places = [r.choice([0, 1, 1, 2, 2, 2]) for _ in entries]
    texts = [None, "", *base, *(x[1:] for x in base), *(x[:-1] for x in base), *(x[r.randint(0, 9) :] + y for x in base for y in base[:4])]
    expected = [min((p for e, p in zip(entries, places) if t and e in t), default=dictionary.NONE) for t in texts]
    assert len(set(expected)) == 4
    tree = dictionary.Tree(pa.array(entries), np.array(places))
    assert tree.best_places(pa.array(["bbb", *texts])[1:]).tolist() == expected


def test_a_dictionary_is_small_in_a_worker_and_not_in_the_job(spark):
    entries = [f"{i * 7919 % 100_000:05d}entry{i}" for i in range(100_000)]
    tree = dictionary.Tree(pa.array(entries), np.zeros(len(entries), int))
    arrays = [x for last, on in tree.levels for steps in [*last.values(), on] if steps for x in vars(steps).values() if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in arrays) + sum(marks.there.nbytes for marks in tree.marks.values()) < 80 * len(entries)
    table = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("entry"), F.lit("good").alias("rating"))
    assert len(cloudpickle.dumps(dictionary.entries_of(table, ["good"]))) < 1000
    rated = dictionary.rating_from_entries(table.select("entry"), "entry", table, ["good"], "rating")
    assert rated.filter("rating = 'good'").count() == 20_000


# ---- frequent values -----------------------------------------------------------


@pytest.mark.parametrize("most", [10_000, 3])
@pytest.mark.parametrize("top_n", [1, 4, 100])
def test_top_values_by_hashes(spark, monkeypatch, most, top_n):
    monkeypatch.setattr(profile, "MOST_CANDIDATES", most)
    monkeypatch.setattr(profile, "PREFIX", 3)
    r = random.Random(top_n)
    rows = [(r.choice(["abc1", "abc2", "abcd", "b", "", " ", None]), r.choice([1, 2, None]), f"abc{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "t string, n int, u string").repartition(3)
    found = {(x.Column, x.rank): (x.Value, x.Count, round(x.Percentage, 6)) for x in profile.top_values(df, top_n=top_n).collect()}
    expected = {}
    for j, name in enumerate(("t", "n", "u")):
        present = [str(row[j]) for row in rows if row[j] is not None and str(row[j]).strip()]
        ordered = sorted(Counter(present).items(), key=lambda x: (-x[1], x[0]))[:top_n]
        expected |= {(name, i): (v, n, round(100 * n / len(present), 6)) for i, (v, n) in enumerate(ordered, 1)}
    assert found == expected


def test_long_texts_are_no_keys_of_an_exchange(spark):
    df = spark.createDataFrame([("x" * 500 + str(i % 7),) for i in range(50)], "t string")
    counted = profile._keyed_counts(profile._cells(df, ["t"]))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", counted)
    assert keys and all("Value" not in k for k in keys)
    longest = profile._keyed_counts(profile._cells(df, ["t"])).agg(F.max(F.length("key"))).first()[0]
    assert longest == profile.PREFIX + 33
