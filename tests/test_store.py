"""The page store, and which rows with html get into a shuffle."""

import pytest
from pyspark.sql import functions as F

from hailbook import derived, session
from hailbook.operators import key_filter, pages, sites
from hailbook.plans.run import plan_run
from hailbook.queries import QUERIES
from hailbook.sinks.pages import write_page_store
from hailbook.schema import RESPONSES
from hailbook.sources.responses import read_page_store
from tests.test_run import LINES, ROWS


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def nodes(plan):
    """All nodes of an executed plan, into the stages that ran."""
    yield plan
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    for child in [*inner, *(children.apply(n) for n in range(children.length()))]:
        yield from nodes(child)


def html_exchanges(frame):
    """The shuffles of a frame's plan that move html."""
    found = nodes(frame._jdf.queryExecution().executedPlan())
    moved = [n for n in found if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    return [n for n in moved if "html" in n.output().mkString(",")]


def test_the_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    passed = key_filter.may_hold(rows, "key", key_filter.key_filter(keys, "key"))
    own, other = passed.agg(F.count_if(F.col("id") < 200_000), F.count_if(F.col("id") >= 200_000)).first()
    assert own == 200_000 and other < 0.002 * 800_000
    none = key_filter.key_filter(keys.limit(0), "key")
    assert key_filter.may_hold(rows, "key", none).count() == 0
    assert key_filter.may_hold(rows.limit(0), "key", none).columns == ["key", "id"]


def test_only_wanted_rows_are_shuffled(spark, no_broadcast, tmp_path):
    path = str(tmp_path / "responses")
    url = F.concat(F.lit("https://h.com/"), F.col("id").cast("string"))
    spark.range(40_000).select(
        url.alias("requested_url"), url.alias("final_url"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), F.concat(F.lit("<p>"), "id").alias("html"),
    ).write.parquet(path)
    accepted = pages.accepted_pages(spark.read.schema(RESPONSES).parquet(path))
    wanted = spark.range(0, 40_000, 20).select(url.alias("requested_url"))
    found = pages.wanted_pages(accepted, wanted).select("requested_url", "html")
    assert len(found.collect()) == 2_000
    (moved,) = html_exchanges(found)
    entered = moved.metrics().apply("shuffleRecordsWritten").value()
    assert 2_000 <= entered <= 2_000 * 1.02


def test_a_store_gives_the_rows_of_plain_files_without_moving_html(spark, no_broadcast, tmp_path):
    responses = spark.createDataFrame([*ROWS, (None, "x", 200, "text/html", "")], RESPONSES)
    write_page_store(responses, str(tmp_path / "store"), 8)
    stored = read_page_store(spark, str(tmp_path / "store"))
    assert stored.schema == RESPONSES
    assert sorted(stored.collect(), key=str) == sorted(responses.filter("requested_url is not null").collect(), key=str)
    assert spark.catalog.listTables() == []
    todo = sites.clean_sites(spark.createDataFrame(list(enumerate(LINES)), "position int, value string"))
    none = spark.createDataFrame([], "domain string")
    staged = []

    def stage(frame, name):
        staged.append((name, frame))
        return session.staged(frame, name)

    for limit in (10, 12):
        plain = plan_run(todo, none, responses, limit).report().collect()
        staged.clear()
        run = plan_run(todo, none, stored, limit, stage)
        assert sorted(run.report().collect(), key=str) == sorted(plain, key=str)
        staged.append(("report", run.report()))
        moved = {name: [n.output().mkString(",") for n in html_exchanges(frame)] for name, frame in staged}
        assert moved == {name: [] for name in moved}
    frame = pages.wanted_pages(pages.accepted_pages(stored), todo.select(F.col("site").alias("requested_url")))
    assert "Bucketed: true" in frame._jdf.queryExecution().executedPlan().toString()



@pytest.fixture
def tables(spark, tmp_path):
    """Orders, items of them and one web page, as the derived views read them."""
    orders = spark.range(1, 41).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"))
    items = spark.range(120).select(
        (F.col("id") % 40 + 1).alias("l_orderkey"), (F.col("id") % 6 + 1).cast("int").alias("l_linenumber"),
        F.col("id").alias("l_partkey"), (F.col("id") + 3).alias("l_suppkey"),
    )
    web = spark.createDataFrame(
        [(1, "https://a.com/x", "<a href='/y'>y</a><a href='https://b.com/'>b</a><a href='//A.com/z'>z</a>")],
        "page_id long, url string, html string",
    )
    regions = spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string")
    for name, rows in {"orders": orders, "lineitem": items, "pages": web, "region": regions}.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_page_views_move_narrow_rows_to_tasks_that_grow_with_them(spark, tables, monkeypatch):
    """html is built behind the shuffle, which has more tasks for more rows."""
    monkeypatch.setattr(derived, "SEEDS_PER_TASK", 9)
    for name in ("contact_pages", "responses"):
        plan = derived.view(spark, tables, name)._jdf.queryExecution().executedPlan().toString()
        below = [part.split("FileScan")[0] for part in plan.split("Exchange")[1:]]  # what each exchange reads
        assert below and not any("DOCTYPE" in part for part in below)
        assert ", 14), REPARTITION_BY_NUM" in plan  # 120 items by 9


def test_links_of_a_domain_are_resolved_once(spark, tables):
    """No filter of rows, which would repeat the resolution below the projection."""
    found = QUERIES["same_domain_links"](spark, tables)
    assert "\n+- Filter" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and ":- Filter" not in plan
    rows = found.filter("url = 'https://a.com/x'").select("pos", "target").collect()
    assert sorted(map(tuple, rows)) == [(0, "https://a.com/y"), (2, "https://A.com/z")]
