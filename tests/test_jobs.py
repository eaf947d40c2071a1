"""The jobs on copies of the tables: growing input, reruns, failures, and rows against plain Python."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import _cli, panel_watch, passage_screen, registered

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("driver tables are absent", allow_module_level=True)

ROOT = Path(__file__).resolve().parents[1]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture()
def arriving(spark, tmp_path):
    """Three files of events, and a folder into which a test puts them one after another."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    (tmp_path / "events").mkdir()

    def arrive(i):
        (file,) = (tmp_path / f"part{i}").glob("part-*.parquet")
        shutil.copy(file, tmp_path / "events" / f"{i}.parquet")

    return arrive


def watch(spark, base, **settings):
    return panel_watch.run(spark, str(base / "events"), f"{SF}/nation.parquet", str(base / "out"), str(base / "checkpoint"), panel_watch.Settings(**settings))


def test_new_files_are_taken_once_and_add_up(spark, tmp_path, arriving):
    whole = tmp_path / "whole"
    panel_watch.run(spark, f"{SF}/events.parquet", f"{SF}/nation.parquet", str(whole / "out"), str(whole / "checkpoint"))
    want = rows(panel_watch.read(spark, str(whole / "out")))
    arriving(0)
    assert watch(spark, tmp_path) == 1
    first = rows(panel_watch.read(spark, str(tmp_path / "out")))
    assert first != want
    assert watch(spark, tmp_path) == 0 and rows(panel_watch.read(spark, str(tmp_path / "out"))) == first
    arriving(1)
    arriving(2)
    assert watch(spark, tmp_path, max_files=1) == 2
    assert rows(panel_watch.read(spark, str(tmp_path / "out"))) == want
    assert any(r.called for r in panel_watch.read(spark, str(tmp_path / "out")).collect())


def test_a_batch_that_failed_runs_again_without_counting_twice(spark, tmp_path, arriving, monkeypatch):
    arriving(0)
    watch(spark, tmp_path)
    arriving(1)

    def fails(*a, **b):
        raise OSError("the disk is full")

    with monkeypatch.context() as m:
        m.setattr(panel_watch, "sites", fails)  # the sums of the batch are written, its calls are not
        with pytest.raises(Exception, match="disk is full"):
            watch(spark, tmp_path)
    assert (tmp_path / "checkpoint/sums/batch=1").exists()
    assert watch(spark, tmp_path) == 1
    both = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 3 < 2")
    both.coalesce(1).write.parquet(str(tmp_path / "both/events"))
    watch(spark, tmp_path / "both")
    assert rows(panel_watch.read(spark, str(tmp_path / "out"))) == rows(panel_watch.read(spark, str(tmp_path / "both/out")))


def test_only_touched_chromosomes_are_rewritten(spark, tmp_path, arriving):
    arriving(0)
    watch(spark, tmp_path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*.parquet")}
    one = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 25 = 3 and event_id % 3 = 1")
    one.coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*.parquet")
    shutil.copy(file, tmp_path / "events" / "late.parquet")
    assert watch(spark, tmp_path) == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*.parquet")}
    changed = {p.parent.name for p in set(before) ^ set(after)} | {p.parent.name for p in set(before) & set(after) if before[p] != after[p]}
    touched = {f"chromosome={r[0]}" for r in spark.read.parquet(str(tmp_path / "checkpoint/counts/batch=1")).select("chromosome").distinct().collect()}
    assert changed == touched and 0 < len(changed) < 25


def test_no_reads_no_calls(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").where("false").coalesce(1).write.parquet(str(tmp_path / "events"))
    watch(spark, tmp_path)
    assert panel_watch.read(spark, str(tmp_path / "out")).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, extra string"


def screen(spark, base, docs, items, **settings):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(str(base / "docs"))
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(str(base / "items"))
    passage_screen.run(spark, str(base / "docs"), str(base / "items"), str(base / "out"), passage_screen.Settings(**settings))
    return passage_screen.read(spark, str(base / "out"))


def by_hand(docs, items, k=24, stride=6, piece=300, max_hits=8, support=4):
    """The finds by plain loops."""
    lower = str.maketrans(passage_screen.UPPER, passage_screen.LOWER)
    texts: dict = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    start, at = {}, 0
    for i in sorted(texts):
        start[i], at = at, at + len(texts[i])
    index: dict = {}
    for i, t in texts.items():
        t = t.translate(lower)
        for p in range(len(t) - k + 1):
            index.setdefault(t[p : p + k], []).append((start[i] + p, i, p))
    out: dict = {}
    for doc, text, lang, source, _ in docs:
        if doc is None or text is None:
            continue
        text, n = text.translate(lower), 0
        while n == 0 or n * (piece - k + 1) + k - 1 < len(text):
            cut = text[n * (piece - k + 1) :][:piece]
            seeds = [(o, g, i, p) for o in range(0, len(cut) - k + 1, stride) for g, i, p in sorted(index.get(cut[o : o + k], [])) if len(index[cut[o : o + k]]) <= max_hits]
            backed = [sum(1 for y in seeds[:j] if y[1] < x[1] and y[0] < x[0] and abs((x[1] - y[1]) - (x[0] - y[0])) < 100) for j, x in enumerate(seeds)]
            if backed and max(backed) >= support:
                x = seeds[backed.index(max(backed))]
                row = out.setdefault((doc, x[2]), [source, 0, 0, 0.0, (10**9, 0), lang or "none"])
                row[1:5] = row[1] + 1, row[2] + len(seeds), max(row[3], k + 0.4 * k * max(backed)), min(row[4], (n * (piece - k + 1) + x[0], x[3]))
            n += 1
    return sorted((d, i, s, n, m, round(b, 6), *at, part) for (d, i), (s, n, m, b, at, part) in out.items())


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "item_id", "source", "n_pieces", "n_seeds", "best_score", "text_at", "item_at", "part").collect())


def test_finds_by_hand(spark, tmp_path):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    a, b = items[0][1], items[1][1]
    docs = [(*r, "x") for r in table]
    n = 10_000
    docs += [(n, None, "en", "s", "x"), (None, a, "en", "s", "x"), (n + 1, "", "en", "s", "x"), (n + 2, a.upper(), None, "s", "x"), (n + 3, "ä" * 290 + a + " and " + b, "", None, "x")]
    docs += [(n + 4, ("filler words " * 9_000) + b, "de", "s", "x"), (n + 5, a[:60] + "?" + a[61:], "fr", "s", "x"), (n + 6, a[:30], "fr", "s", "x"), (n + 7, a, "fr", "s", "x"), (n + 8, a, "fr", "s", "x")]
    items += [(None, "x" * 90), (900, None), (901, ""), (902, a[:100]), (0, "zz" + a)]
    items += [(910 + i, "the same words in every one of ten passages " + str(i) * 30) for i in range(10)]
    docs += [(n + 9, "the same words in every one of ten passages", "en", "s", "x")]
    want = by_hand(docs, items)
    assert got(screen(spark, tmp_path, docs, items)) == want
    assert {d for d, *_ in want} >= {n + 2, n + 3, n + 4, n + 5, n + 7, n + 8} and not {d for d, *_ in want} & {n, n + 1, n + 6, n + 9}
    again = got(screen(spark, tmp_path, docs, items))
    assert again == want
    fewer = [d for d in docs if (d[2] or "none") != "de"]
    assert got(screen(spark, tmp_path, fewer, items)) == by_hand(fewer, items)  # no partition of an earlier run stays


def test_an_index_too_large_to_broadcast_gives_the_same(spark, tmp_path, monkeypatch):
    docs = [(i, f"{chr(97 + i)} quick brown fox that jumps over {i} lazy dogs, and so on until it is tired and sleeps", "en", "s", None) for i in range(5)]
    items = [(1, "quick brown fox that jumps over 3 lazy dogs, and so on until it is tired"), (2, "nothing of the sort is in any of these texts at all, is it")]
    want = got(screen(spark, tmp_path, docs, items))
    monkeypatch.setattr(passage_screen, "small", lambda df: df)
    assert want == got(screen(spark, tmp_path, docs, items)) == by_hand(docs, items) and want


def test_empty_tables(spark, tmp_path):
    assert screen(spark, tmp_path, [], [(1, "some text of a passage that is long enough")]).count() == 0
    assert screen(spark, tmp_path, [(1, "some text", "en", "s", None)], []).count() == 0


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_registered_jobs_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "nation", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registered.queries()[name](spark, SF)
    want = con.sql(registered.oracle_sql()[name]).select(*(f'"{c}"' for c in df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_settings_are_restored_and_unknown_ones_refused(spark, tmp_path, arriving):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    arriving(0)
    watch(spark, tmp_path)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    with pytest.raises(ValueError, match="speed"):
        _cli.settings(panel_watch.Settings, {"speed": 1})
    for job in (panel_watch, passage_screen):
        given = json.loads((ROOT / f"jobs/{job.__name__.split('.')[1]}.json").read_text())
        assert set(given["paths"]) == set(job.PATHS) and _cli.settings(job.Settings, given["settings"]) == job.Settings()


def test_command_line(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"paths": {"passages": f"{SF}/benchmark.parquet", "out": str(tmp_path / "out")}, "settings": {"support": 5}}))
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.passage_screen", "--config", str(config), "--documents", f"{SF}/documents.parquet"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "finds to" in done.stderr and list((tmp_path / "out/finds").glob("part=*/part-*.parquet"))
