"""Files, joins and the whole run on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from hailbook.operators import crawl, pages, report, sites, skew
from hailbook.plans.run import plan_run, run_sites
from hailbook.queries import QUERIES
from hailbook.schema import RESPONSES
from hailbook.session import staged
from hailbook.sinks.lines import append_processed_domains, save_cleaned_sites, save_lines
from hailbook.sinks.results import append_results
from hailbook.sources.lines import load_processed_domains, load_sites, read_lines
from hailbook.sources.results import load_existing_result_urls, read_results
from hailbook.streaming import incremental
from hailbook.streaming.incremental import (
    append_new,
    page_contact_rows,
    stream_pages,
    unprocessed_pages,
)

HTML = "text/html; charset=utf-8"
HOME = (
    "<title>A Ltd</title><p>one@a.com</p><a href='/p/1'>p</a><a href='/help/me'>h</a>"
    "<a href='https://b.com/x'>b</a>"
)
ROWS = [
    ("https://a.com", "https://a.com", 200, HTML, HOME),
    ("https://a.com/contacts", "https://a.com/c", 200, HTML, "<p>two@a.com one@a.com 8 912 345 67 89"),
    ("https://a.com/contact", "https://a.com/c", 200, HTML, "<p>dropped@a.com"),
    ("https://a.com/about", "https://a.com/about", 404, HTML, "<p>gone@a.com"),
    ("https://a.com/team", "https://a.com/team", 200, "application/pdf", "<p>pdf@a.com"),
    ("https://a.com/help", "https://a.com", 200, HTML, "<p>home again"),
    ("https://a.com/support", "https://a.com/support", 200, "TEXT/PLAIN", "tg: @a_team"),
    ("https://a.com/help/me", "https://a.com/help/me", 200, HTML, "<p>deep1@a.com"),
    ("https://a.com/p/1", "https://a.com/p/1", 200, HTML, "<p>deep2@a.com"),
    ("https://b.com", "https://b.com", 500, HTML, "x"),
    ("http://b.com", "http://www.b.com/home", 200, HTML, "<title></title>b@b.com"),
    ("http://www.b.com/home/contact", "http://www.b.com/home/contact", 200, HTML, "<title>B</title>"),
    ("https://c.com", None, None, None, None),
    ("https://d.com", "https://d.com", 200, None, "no type"),
    ("https://e.com", "https://e.com", 200, HTML, "e@e.com"),
    ("https://e.com", "https://e.com", 200, HTML, "e@e.com"),
]
LINES = ["a.com", "", " A.com/ ", "http://c.com", "https://b.com?x", "d.com", "e.com", "http://E.com", "f.com"]


@pytest.fixture
def responses(spark):
    return spark.createDataFrame(ROWS, RESPONSES)


@pytest.fixture
def site_file(tmp_path):
    path = tmp_path / "sites.txt"
    path.write_bytes("\r\n".join(LINES).encode() + b"\nbad\xff.com\n")
    return str(path)


def test_lines(spark, site_file, tmp_path):
    values = [r["value"] for r in read_lines(spark, site_file).orderBy("position").collect()]
    assert values == [line.strip() for line in LINES if line.strip()] + ["bad�.com"]
    assert read_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        load_sites(spark, str(tmp_path / "none"))
    frame = spark.createDataFrame([(2, " b  c "), (1, "a"), (3, " ")], "i int, value string")
    save_lines(frame, str(tmp_path / "out"), "i")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b c"]


def test_clean_sites_and_state(spark, site_file, tmp_path):
    cleaned = str(tmp_path / "cleaned")
    save_cleaned_sites(load_sites(spark, site_file), cleaned)
    wanted = [
        *("https://a.com", "http://c.com", "https://b.com", "https://d.com", "https://e.com"),
        *("http://e.com", "https://f.com", "https://bad�.com"),
    ]
    assert [r["value"] for r in read_lines(spark, cleaned).orderBy("position").collect()] == wanted
    state = str(tmp_path / "processed")
    assert load_processed_domains(spark, state).count() == 0
    for site in (["https://e.com", "https://f.com"], ["http://e.com"]):
        append_processed_domains(spark.createDataFrame([(s,) for s in site], "site string"), state)
    done = load_processed_domains(spark, state)
    assert sorted(r[0] for r in done.collect()) == ["e.com", "f.com"]
    todo = sites.unprocessed_sites(load_sites(spark, site_file), done)
    assert [r["site"] for r in todo.orderBy("position").collect()] == [
        w for w in wanted if not w.endswith(("e.com", "f.com"))
    ]


def test_results_csv(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [("A, \"B\" Ltd", "a@b.c; d@e.f", "", "+79", " https://a.com "), ("", "", "@x", "", "https://b.com")]
    assert load_existing_result_urls(spark, path).count() == 0
    for row in rows:
        append_results(spark.createDataFrame([row], "site_name string, emails string, telegrams string, phones string, url string"), path)
    assert sorted(tuple(r) for r in read_results(spark, path).collect()) == sorted(rows)
    raw = sorted(p.read_bytes() for p in (tmp_path / "results").glob("part-*.csv"))
    assert b'site_name,emails,telegrams,phones,url\r\n"A, ""B"" Ltd",a@b.c; d@e.f,,+79, https://a.com \r\n' in raw
    assert sorted(r[0] for r in load_existing_result_urls(spark, path).collect()) == ["https://a.com", "https://b.com"]


def test_run_twice(spark, site_file, responses, tmp_path):
    out = [str(tmp_path / name) for name in ("cleaned", "results", "processed")]
    summary = run_sites(spark, site_file, responses, *out)
    assert summary.asDict() == {"total_sites": 8, "success_sites": 3, "skipped_sites": 0, "failed_sites": 5}
    rows = sorted(tuple(r) for r in read_results(spark, out[1]).collect())
    assert rows == [
        ("", "e@e.com", "", "", "https://e.com"),
        ("A Ltd", "one@a.com; two@a.com", "@a_team", "+79123456789", "https://a.com"),
        ("B", "b@b.com", "", "", "http://www.b.com/home"),
    ]
    again = run_sites(spark, site_file, responses, *out)
    assert again.asDict() == {"total_sites": 8, "success_sites": 0, "skipped_sites": 8, "failed_sites": 0}
    assert read_results(spark, out[1]).count() == 3
    empty = tmp_path / "empty.txt"
    empty.write_text("\n \n")
    assert run_sites(spark, str(empty), responses, *out) is None
    with pytest.raises(ValueError):
        run_sites(spark, site_file, responses, *out, max_pages=0)


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_deep_visit_does_not_depend_on_partitions(spark, responses, partitions):
    lines = spark.createDataFrame(list(enumerate(LINES)), "position int, value string")
    none = spark.createDataFrame([], "domain string")
    run = plan_run(
        sites.clean_sites(lines.repartition(partitions)), none, responses.repartition(partitions), 12
    )
    kept = run.site_pages.filter(F.col("site") == "https://a.com").orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in kept] == [
        (0, "https://a.com"), (1, "https://a.com/c"), (6, "https://a.com/support"),
        (11, "https://a.com/help/me"), (12, "https://a.com/p/1"),
    ]
    status = {r["site"]: r for r in run.status.collect()}
    assert len(status["https://a.com"]["checked_urls"]) == 13
    assert not status["https://d.com"]["success"] and status["https://d.com"]["checked_urls"] == []
    counts = {r["site"]: r.asDict() for r in report.site_contact_counts(run.site_pages).collect()}
    assert counts["https://a.com"] == {"site": "https://a.com", "pages": 5, "emails": 5, "telegrams": 1, "phones": 1}


def test_accepted_pages(responses):
    kept = pages.accepted_pages(responses).select("requested_url").collect()
    dropped = {"https://a.com/about", "https://a.com/team", "https://b.com", "https://c.com", "https://d.com"}
    assert sorted(r[0] for r in kept) == sorted(r[0] for r in ROWS if r[0] not in dropped)


def test_entry_falls_back_to_http_only_from_https(spark, responses):
    given = spark.createDataFrame([("https://b.com",), ("http://a.com",), ("https://a.com",)], "site string")
    keys = pages.page_keys(pages.accepted_pages(responses))
    found = {r["site"]: (r["requested_url"], r["site_url"]) for r in crawl.entry_pages(given, keys).collect()}
    assert found == {
        "https://b.com": ("http://b.com", "http://www.b.com/home"),
        "https://a.com": ("https://a.com", "https://a.com"),
    }


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "key string, v int")
    plain = left.join(right, "key", how)
    salted = skew.salted_join(left, right, "key", how, ["id"], rows_per_task=40)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    hot = {r["parts"] for r in skew.hot_keys(left, "key", 40).collect()}
    assert max(hot) == 25


def test_every_hot_key_is_split(spark):
    left = spark.range(60_000).select("id", (F.col("id") % 3000).alias("key"))
    hot = skew.hot_keys(left, "key", 9).collect()
    assert len(hot) == 3000 and {r["parts"] for r in hot} == {3}
    right = spark.range(1500).select(F.col("id").alias("key"))
    kept = skew.salted_join(left, right, "key", "left_anti", ["id"], rows_per_task=9)
    assert kept.count() == 30_000


def test_hot_domains_of_the_skip_join(spark, monkeypatch):
    given = spark.range(200).select(
        F.col("id").alias("position"), F.concat(F.lit("https://h"), F.col("id") % 9, F.lit(".com/"), "id").alias("site")
    )
    done = spark.createDataFrame([("h1.com",), ("h4.com",)], "domain string")
    plain = sorted(map(tuple, sites.unprocessed_sites(given, done).collect()))
    assert len(plain) == 155
    monkeypatch.setattr(skew.salted_join, "__defaults__", (5, None))
    assert sorted(map(tuple, sites.unprocessed_sites(given, done).collect())) == plain


def test_missing_final_urls_and_duplicates(spark, responses):
    rows = [
        ("https://n.com", None, 200, HTML, "<title>N</title>n@n.com"),
        ("https://n.com", "https://n.com/z", 200, HTML, "<title>Z</title>"),
        ("https://n.com/contacts", None, 200, HTML, "c@n.com"),
        (None, "https://n.com", 200, HTML, "never"),
    ]
    pages_ = responses.union(spark.createDataFrame(rows, RESPONSES))
    accepted = pages.accepted_pages(pages_)
    keys = {r["requested_url"]: r["final_url"] for r in pages.page_keys(accepted).collect()}
    parsed = {r["requested_url"]: r["final_url"] for r in pages.parsed_pages(accepted).collect()}
    assert keys == parsed and keys["https://n.com"] == "https://n.com" and None not in keys
    lines = spark.createDataFrame([(0, "n.com")], "position int, value string")
    run = plan_run(sites.clean_sites(lines), spark.createDataFrame([], "domain string"), pages_)
    (row,) = run.report().collect()
    assert (row["site_name"], row["emails"], row["url"]) == ("N", "n@n.com; c@n.com", "https://n.com")


def test_result_files_are_read_by_column_name(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "a.csv").write_text('url,site_name\nhttps://a.com,"A, B"\n')
    (folder / "b.csv").write_text("phones,extra,url,url\n+7,x,https://b.com,no\n")
    (folder / "c.csv").write_text("")
    found = sorted(tuple(r) for r in read_results(spark, str(folder)).collect())
    assert found == [("", "", "", "+7", "https://b.com"), ("A, B", "", "", "", "https://a.com")]
    assert sorted(r[0] for r in load_existing_result_urls(spark, str(folder)).collect()) == ["https://a.com", "https://b.com"]


@pytest.mark.parametrize("step", ["append_results", "append_processed_domains", "publish"])
@pytest.mark.parametrize("before", [True, False])
def test_a_run_that_breaks_off_loses_and_doubles_nothing(spark, site_file, responses, tmp_path, monkeypatch, step, before):
    from hailbook.sinks import runs

    out = [str(tmp_path / name) for name in ("cleaned", "results", "processed")]
    work = getattr(runs, step)

    def fail(*args):
        if not before:
            work(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, step, fail)
        with pytest.raises(RuntimeError):
            run_sites(spark, site_file, responses, *out)
    whole = step == "publish" and not before  # it was published, only nobody was told
    assert read_results(spark, out[1]).count() == (3 if whole else 0)
    assert load_processed_domains(spark, out[2]).count() == (7 if whole else 0)
    with open(site_file, "a") as more:
        more.write("http://www.b.com/home\n")  # another list than the one that broke off
    run_sites(spark, site_file, responses, *out)
    rows = sorted(r["url"] for r in read_results(spark, out[1]).collect())
    assert rows == ["http://www.b.com/home", "https://a.com", "https://e.com"]
    assert run_sites(spark, site_file, responses, *out).skipped_sites == 9
    assert sorted(r["url"] for r in read_results(spark, out[1]).collect()) == rows


def test_plain_lines_and_published_runs_make_the_state(spark, tmp_path):
    from hailbook.sinks.runs import write_run

    out, state = str(tmp_path / "results"), str(tmp_path / "state")
    append_processed_domains(spark.createDataFrame([("https://old.com",)], "site string"), state)
    rows = spark.createDataFrame([("", "", "", "", "https://new.com")], read_results(spark, out).schema)
    write_run(rows, spark.createDataFrame([("https://new.com",)], "site string"), out, state)
    append_results(rows, f"{out}/run=never-published")
    append_processed_domains(spark.createDataFrame([("https://lost.com",)], "site string"), f"{state}/run=x")
    assert sorted(r[0] for r in load_processed_domains(spark, state).collect()) == ["new.com", "old.com"]
    assert read_results(spark, out).count() == 1


def test_results_with_line_breaks_in_quotes(spark, tmp_path):
    import csv
    import random

    r = random.Random(1)
    pieces = ["a", '"', ",", "\n", "\r\n", "é", " ", ""]
    folder = tmp_path / "results"
    folder.mkdir()
    want = []
    for number in range(12):
        names = ["site_name", "emails", "telegrams", "phones", "url", "extra"]
        r.shuffle(names)
        names = names[: r.randint(1, 6)]
        with open(folder / f"{number}.csv", "w", newline="", encoding="utf-8-sig" if number % 2 else "utf-8") as file:
            write = csv.writer(file, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
            write.writerow(names)
            for _ in range(30):
                row = ["".join(r.choices(pieces, k=r.randint(0, 5))) for _ in range(r.randint(1, 7))]
                write.writerow(row)
        with open(folder / f"{number}.csv", newline="", encoding="utf-8-sig") as file:
            for row in csv.DictReader(file):
                want.append(tuple(row.get(c) or "" for c in ("site_name", "emails", "telegrams", "phones", "url")))
    frame = read_results(spark, str(folder))
    assert sorted(tuple(row) for row in frame.collect()) == sorted(want)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_pages_are_parsed(spark, responses):
    lines = spark.createDataFrame(list(enumerate(LINES)), "position int, value string")
    plans = {}

    def stage(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    plan_run(sites.clean_sites(lines), spark.createDataFrame([], "domain string"), responses, stage=stage)
    assert "html" not in "".join(r for r in plans["status"].splitlines() if "LogicalRDD" not in r and "Filter" not in r)
    rows = plans["pages"].splitlines()
    parse = min(n for n, row in enumerate(rows) if "regexp_extract" in row)
    join = min(n for n, row in enumerate(rows) if "Join Inner, (requested_url" in row)
    assert parse < join  # the functions stand above the join


def test_the_site_list_is_cleaned_once(spark, responses):
    lines = spark.createDataFrame(list(enumerate(LINES)), "position int, value string")
    plans = {}

    def stage(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(df, name)

    plan_run(sites.clean_sites(lines), spark.createDataFrame([], "domain string"), responses, stage=stage)
    assert "RLIKE" in plans["sites"] and "RLIKE" not in plans["todo"]


def test_report_shuffles_site_pages_once(spark, responses):
    lines = spark.createDataFrame(list(enumerate(LINES)), "position int, value string")
    run = plan_run(sites.clean_sites(lines), spark.createDataFrame([], "domain string"), responses)
    plan = run.report()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(site") == 1
    assert "html" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stream_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.com/{i}", f"<title>t{i}</title>m{i}@h.com") for i in range(9)]
    folder, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = spark.createDataFrame([("h1.com",)], "domain string")
    for part in (frame.filter("page_id < 5"), frame.filter("page_id >= 5"), frame.limit(0)):
        part.write.mode("append").parquet(folder)
        append_new(page_contact_rows(unprocessed_pages(stream_pages(spark, folder), done)), target, check)
    batch = page_contact_rows(unprocessed_pages(frame, done))
    found = spark.read.parquet(target)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert found.count() == 6


@pytest.mark.parametrize("files", [0, 2])
def test_the_streamed_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path, files):
    rows = [(i, f"https://h{i}.{'org' if i % 3 else 'com'}/", f"m{i}@h.com") for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    if files:
        frame.repartition(files).write.parquet(f"{tmp_path}/pages.parquet")
    else:
        frame.toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["incremental_pages"](spark, str(tmp_path)).select("page_id", "emails").collect()
    assert sorted(map(tuple, found)) == [(0, "m0@h.com"), (3, "m3@h.com")]


def stream_rows(frame, done):
    return unprocessed_pages(frame, done).count()


def test_stream_splits_hot_domains_and_keeps_a_state(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.com/{i}", f"m{i}@h.com") for i in range(30)]
    folder, target, state, check = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = spark.createDataFrame([("h1.com",)], "domain string")
    hot = incremental.busy_domains(frame, 3)
    assert hot.count() == 3
    frame.write.parquet(folder)
    stream = page_contact_rows(unprocessed_pages(stream_pages(spark, folder), done, hot))
    incremental.append_new_with_state(stream, target, state, check)
    assert spark.read.parquet(target).count() == 20
    frame.limit(1).write.mode("append").parquet(folder)
    incremental.append_new_with_state(stream, target, state, f"{check}-new")  # nothing of before is replaced
    assert spark.read.parquet(target).count() == 20 + 20 + stream_rows(frame.limit(1), done)
    handled = load_processed_domains(spark, state)
    assert sorted(r[0] for r in handled.collect()) == ["h0.com", "h2.com"]
    assert unprocessed_pages(frame, handled).count() == 10


def test_hot_keys_are_counted_without_a_shuffle_of_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(skew, "staged", lambda df, name: kept.append(df) or df)
    skew.hot_keys(spark.range(1000).withColumnRenamed("id", "key"), "key", 9)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key_hash" not in plan and "hashpartitioning(key" not in plan
    assert plan.count("Range") == 1 and "approx_top_k_accumulate" in plan.lower().replace("approxtopk", "approx_top_k_")


def test_no_rows_have_no_hot_keys(spark):
    none = spark.range(9).filter("id < 0").select(F.col("id").alias("key"))
    assert skew.hot_keys(none, "key", 9).collect() == []
    assert skew.hot_keys(spark.range(9).repartition(3).filter(F.rand(0) < 0).select(F.col("id").alias("key")), "key").collect() == []


def test_a_key_above_the_limit_is_never_left_out(spark):
    """Far more keys than a sketch tracks; the hot ones are spread over all tasks."""
    rows = spark.range(0, 3_000_000, numPartitions=6).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 3000 / 10).otherwise(F.col("id")).cast("long").alias("key")
    )
    hot = skew.hot_keys(rows, "key", 500)
    exact = rows.groupBy(F.xxhash64("key").alias("key_hash")).count().filter("count > 500")
    assert exact.count() == 300 and exact.join(hot, "key_hash", "left_anti").isEmpty()


def test_a_stream_learns_of_the_domains_it_wrote(spark, tmp_path, monkeypatch):
    """Late files, a restart, a new checkpoint and a break between rows and state: each domain counts in one batch."""
    folder, target, state, check = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    columns = "page_id long, url string, html string"
    page = lambda i, host: (i, f"https://{host}.com/{i}", f"m{i}@h.com")

    def arrive(*rows, name=check):
        if rows:
            spark.createDataFrame(list(rows), columns).coalesce(1).write.mode("append").parquet(folder)
        incremental.append_unhandled(stream_pages(spark, folder), target, state, name)

    def found():
        return sorted(r.page_id for r in incremental.unhandled_rows(spark, target, state).collect())

    spark.createDataFrame([("old.com",)], "value string").coalesce(1).write.text(state)
    arrive(page(1, "a"), page(2, "a"), page(3, "old"), page(4, "b"))
    assert found() == [1, 2, 4]
    arrive(page(5, "a"), page(6, "c"))  # restart; a late page of a handled domain
    assert found() == [1, 2, 4, 6]
    arrive()
    arrive(name=f"{check}-new")  # reads all files again
    assert found() == [1, 2, 4, 6]
    real, broken = incremental.publish, []

    def fails(run, path):
        if not broken:
            broken.append(run)
            raise RuntimeError("machine lost")
        real(run, path)

    monkeypatch.setattr(incremental, "publish", fails)
    with pytest.raises(Exception, match="machine lost"):
        arrive(page(7, "d"), page(8, "d"))
    assert found() == [1, 2, 4, 6]
    arrive(name=f"{check}-third")  # another checkpoint after the break
    assert found() == [1, 2, 4, 6, 7, 8]
    arrive()  # the broken batch of the first one, run again
    assert found() == [1, 2, 4, 6, 7, 8]
    domains = sorted(r[0] for r in load_processed_domains(spark, state).collect())
    assert domains == ["a.com", "b.com", "c.com", "d.com", "old.com"]


def test_every_query_has_sql():
    from hailbook.oracles import ORACLES
    from hailbook.queries import QUERIES

    assert list(QUERIES) and set(QUERIES) == set(ORACLES)
