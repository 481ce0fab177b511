"""Access plans, activation helpers and reports on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import activation as A
from quillstrata.operators import derived
from quillstrata.operators import traversal as T
from quillstrata.plans import access as X
from quillstrata.plans import report as Q
from quillstrata.sources import Scratch


@pytest.fixture(scope="module")
def snapshot(spark):
    edge = "source_kind string, source_id string, transition_id string, direction string, target_kind string, target_id string, ord long"
    rows = [("semantic_object", "b1", "object_context", "incoming", "temporal_anchor", x, k) for k, x in enumerate(("j1", "j2"))]
    rows += [("semantic_object", "b2", "object_context", "incoming", "temporal_anchor", "j2", 0), ("semantic_object", "b1", "object_unit", "outgoing", "semantic_unit", "u1", 0)]
    records = [("semantic_object", "b1"), ("semantic_object", "b2"), ("temporal_anchor", "j1"), ("temporal_anchor", "j2"), ("semantic_unit", "u1")]
    units = spark.createDataFrame([("u1", "a whale"), ("u2", "a ship")], "unit_id string, content string")

    def literal(rows, text):
        return units.where(F.col("content").contains(text)).select(F.lit("q").alias("root"), F.lit("semantic_unit").alias("kind"), F.col("unit_id").alias("id"))

    return X.Snapshot(
        spark.createDataFrame(records, "kind string, id string"),
        spark.createDataFrame(rows, edge),
        units,
        spark.createDataFrame([("temporal_anchor", "j1", "2021-05-01"), ("temporal_anchor", "j2", "2020-01-01")], "kind string, id string, anchor string"),
        {"object_context": ("semantic_object", ("incoming",), "temporal_anchor"), "object_unit": ("semantic_object", ("outgoing",), "semantic_unit")},
        {"exact": (("semantic_unit",), ("literal",), 32, True)},
        search={"exact": literal},
        names={"Moby": "b1"},
    )


BOOKS = X.Binding("books", "semantic_object", ("b2",), ("Moby",))


def test_two_book_chronology(snapshot):
    path = X.Path("books", (X.Follow("object_context", "incoming"), X.Temporal("earliest")), "found")
    plan = X.Plan((BOOKS,), (path,), (), (("anchors", "found"),))
    assert X.conform(plan, snapshot).count() == 0
    found = X.execute(plan, snapshot)["found"]
    assert {(r.root, r.id, r.anchor) for r in found.collect()} == {("b1", "j2", "2020-01-01"), ("b2", "j2", "2020-01-01")}
    assert {(r.root, r.id, r.anchor) for r in X.shape(found, "anchors", snapshot).collect()} == {("b1", "j2", "2020-01-01"), ("b2", "j2", "2020-01-01")}
    assert X.shape(found, "exact_total").first().total == 1


def test_branches_join_and_hydrate(snapshot):
    paths = (X.Path("books", (X.Follow("object_unit"), X.Hydrate()), "own"), X.Path("books", (X.Search("exact", "literal", "ship", 5), X.Hydrate()), "other"))
    plan = X.Plan((BOOKS,), paths, (X.Join("group", ("own",), "g"), X.Join("concatenate", ("own",), "c")))
    out = X.execute(plan, snapshot)
    assert [r.content for r in out["own"].collect()] == ["a whale"]
    assert [r.content for r in out["other"].collect()] == ["a ship"]
    assert out["g"].first().branch == "own" and out["c"].first().provenance == "own"


def test_a_limit_keeps_the_best_ranked(spark, snapshot):
    ranked = spark.createDataFrame([("q", "semantic_unit", "9", 1), ("q", "semantic_unit", "1", 2), ("q", "semantic_unit", "2", 3)], "root string, kind string, id string, position long")
    snapshot.search["exact"], literal = (lambda rows, query: ranked), snapshot.search["exact"]
    try:
        plan = X.Plan((BOOKS,), (X.Path("books", (X.Search("exact", "literal", "x", 2),), "found"),))
        assert {r.id: r.position for r in X.execute(plan, snapshot)["found"].collect()} == {"9": 1, "1": 2}
    finally:
        snapshot.search["exact"] = literal


def test_what_is_missing_is_a_status(spark, snapshot):
    ops = (X.Search("nowhere", "literal", "x", 2, required=False), X.Follow("unheard of", required=False), X.Hydrate())
    done = X.run(X.Plan((BOOKS,), (X.Path("books", ops, "found"),)), snapshot, Scratch(spark))
    assert done.bindings["found"].count() == 0
    assert [r.status for r in Q.applied_statuses(done.operations).orderBy("operation_id").collect()] == ["surface_unavailable", "surface_unavailable", "completed_zero_matches"]


def test_each_operation_reads_its_source_once(spark, snapshot, tmp_path):
    """However long the path and however many paths go on from it, an edge table is scanned once an operation."""
    steps = [("semantic_object", f"o{k}", "next", "outgoing", "semantic_object", f"o{k + 1}", 0) for k in range(20)] + [("semantic_object", "o3", "next", "outgoing", "semantic_object", f"x{k}", 0) for k in range(5)]
    spark.createDataFrame(steps, snapshot.edges.schema).write.parquet(f"{tmp_path}/edges")
    stored = X.Snapshot(snapshot.records, spark.read.parquet(f"{tmp_path}/edges"), snapshot.units, snapshot.anchors, {"next": ("semantic_object", ("outgoing",), "semantic_object")}, {})
    plan = X.Plan((X.Binding("a", "semantic_object", ("o0", "o1")),), (X.Path("a", (X.Follow("next"),) * 5, "far"), X.Path("far", (X.Follow("next"),), "b"), X.Path("far", (X.Follow("next"),) * 2, "c")))
    scans = []

    class Counting(Scratch):
        def write(self, df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans.append((plan.count("FileScan"), plan.count(f"{tmp_path}/edges")))
            return super().write(df)

    scratch = Counting(spark)
    done = X.run(plan, stored, scratch)
    assert len(scans) == 8 and all(edges == 1 and every <= 2 for every, edges in scans)
    lazy = X.execute(plan, stored)
    for name in ("far", "b", "c"):
        assert sorted(map(tuple, done.bindings[name].collect())) == sorted(map(tuple, lazy[name].collect()))
    observed = {r.operation_id: r.observed for r in done.operations.collect()}
    assert observed == {"far.1": 2, "far.2": 2, "far.3": 7, "far.4": 7, "far.5": 2, "b.1": 2, "c.1": 2, "c.2": 2}


@pytest.mark.parametrize("roots", [1, 3, 500])
def test_an_order_is_spread_over_tasks(spark, roots):
    """Most rows are of one root; no range has more than twice the rows of the median one."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id") % roots).alias("root"), F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 1000).alias("anchor"), "id")
    rows = rows.withColumn("root", F.when(F.col("root") != 1, F.col("root")))
    scratch = Scratch(spark)
    spread = T.spread_order(rows, "root", ["anchor", "id"], scratch)
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, T.temporal_order(rows, "root", ["anchor", "id"]).collect()))
    sizes = sorted(r["count"] for r in spark.read.parquet(f"{scratch._root}/1").groupBy("_range").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_measured_orders_equal_lazy_ones(spark, snapshot):
    dated = (X.Follow("object_context", "incoming"), X.Temporal("descending"))
    plan = X.Plan((BOOKS,), (X.Path("books", dated, "a"), X.Path("books", dated, "b")), (X.Join("temporal_order", ("a", "b"), "all"),))
    lazy, done = X.execute(plan, snapshot), X.run(plan, snapshot, Scratch(spark))
    for name in ("a", "all"):
        columns = sorted(lazy[name].columns)
        assert sorted(map(repr, done.bindings[name].select(columns).collect())) == sorted(map(repr, lazy[name].select(columns).collect()))


def test_bundles_in_rounds_equal_the_sequential_rule(spark):
    import random

    rng, limits = random.Random(9), {"object": 4, "unit": 6}
    rows = [(t, k, kind, str(rng.randrange(12))) for t in ("a", "b", None, "") for k in range(60) for kind in rng.choices(["object", "unit", "unit", "free"], k=rng.randint(1, 5))]
    expected = set()
    for turn in ("a", "b", None, ""):
        held = set()
        for k in range(60):
            new = {(kind, x) for t, n, kind, x in rows if (t, n) == (turn, k)} - held
            fits = all(sum(kind == y for y, _ in held | new) <= most for kind, most in limits.items())
            held |= new if fits else set()
            expected.add((turn, k, fits, len(new) * fits))
    table = spark.createDataFrame(rows, "turn_id string, bundle_ord long, kind string, id string")
    got = A.place_bundles(table, limits, Scratch(spark)).collect()
    assert len(got) == len(expected) and set(map(tuple, got)) == expected
    assert A.place_bundles(table.limit(0), limits, Scratch(spark)).collect() == []


@pytest.mark.parametrize("needs", [0, 60, 1024])
def test_short_turns_are_placed_in_one_pass(spark, monkeypatch, needs):
    """However many bundles a short turn has, two tables are written; long turns give the same rows in rounds."""
    import random

    rng, limits = random.Random(3), {"object": 5, "obj": 3}
    rows = [(t, k, kind, x) for t, most in (("a", 100), ("b", 20), (None, 40)) for k in range(most) for kind, x in ((rng.choice(["object", "obj", "free", None]), rng.choice(["1", "2", "ect1", "ect2", "ect3", None])) for _ in range(2))]
    expected = set()
    for turn in ("a", "b", None):
        held = set()
        for k in sorted({n for t, n, _, _ in rows if t == turn}):
            new = {(kind, x) for t, n, kind, x in rows if (t, n) == (turn, k)} - held
            fits = all(sum(kind == y for y, _ in held | new) <= most for kind, most in limits.items())
            held |= new if fits else set()
            expected.add((turn, k, fits, len(new) * fits))
    written = []

    class Counting(Scratch):
        def write(self, df):
            written.append(df)
            return super().write(df)

    monkeypatch.setattr(A, "TURN_NEEDS", needs)
    got = A.place_bundles(spark.createDataFrame(rows, "turn_id string, bundle_ord long, kind string, id string"), limits, Counting(spark)).collect()
    assert len(got) == len(expected) and set(map(tuple, got)) == expected
    assert needs < 1024 or len(written) == 2


def test_nothing_is_left_of_a_measured_plan(spark, snapshot):
    with Scratch(spark) as scratch:
        X.run(X.Plan((BOOKS,), (X.Path("books", (X.Follow("object_unit"), X.Search("exact", "literal", "a", 1)), "found"),)), snapshot, scratch)
        root = spark._jvm.org.apache.hadoop.fs.Path(scratch._root)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        assert len(files.listStatus(root)) == 2
    assert not files.exists(root)


def test_temporal_join_orders_branches(snapshot):
    dated = (X.Follow("object_context", "incoming"), X.Temporal("ascending"))
    plan = X.Plan((BOOKS,), (X.Path("books", dated, "a"), X.Path("books", dated, "b")), (X.Join("temporal_order", ("a", "b"), "all"),))
    rows = X.execute(plan, snapshot)["all"].where("root = 'b1'").orderBy("position").collect()
    assert [r.anchor for r in rows] == ["2020-01-01", "2020-01-01", "2021-05-01", "2021-05-01"]


def test_cycles_and_unknown_names_are_errors(snapshot):
    with pytest.raises(ValueError, match="cycle"):
        X.order(X.Plan((), (X.Path("a", (), "b"), X.Path("b", (), "a"))))
    with pytest.raises(KeyError):
        X.shape(snapshot.records, "poem")
    faults = {tuple(r) for r in X.conform(X.Plan((X.Binding("x", "semantic_object", ("b9",), ("Lost",)),)), snapshot).collect()}
    assert faults == {("missing_address", "semantic_object:b9"), ("unresolved_authored_target", "Lost")}


def test_stale_handle_and_filters(spark):
    rows = spark.createDataFrame([("h", k, f"p/{k}") for k in range(7)], "source string, target int, path string")
    handle = {"projection_snapshot_id": "s", "origin_field": "source", "origin": "h", "ordering": ["target"], "next_offset": 2, "page_limit": 3, "filters": {"path_prefix": "p/"}}
    page = A.continue_page(rows, handle, "s").orderBy("target").collect()
    assert [(r.target, r.remaining, r.next_offset) for r in page] == [(2, 2, 5), (3, 2, 5), (4, 2, 5)]
    assert A.page(rows, "source", ["target"], 0, 0).count() == 0
    with pytest.raises(ValueError, match="stale"):
        A.continue_page(rows, handle, "t")
    with pytest.raises(KeyError):
        A.filter_of("mood", 1)


def test_failed_surface_gives_no_view(spark):
    view = spark.range(1)
    assert A.all_or_nothing({"exact": True}, view) is view
    with pytest.raises(RuntimeError):
        A.all_or_nothing({"exact": True, "graph": False}, view)


def test_bundles_share_context(spark):
    rows = [("t", 0, "object", "o"), ("t", 0, "unit", "a"), ("t", 1, "object", "o"), ("t", 1, "unit", "b"), ("t", 2, "object", "p"), ("t", 2, "unit", "c"), ("t", 3, "object", "o"), ("t", 3, "unit", "a")]
    placed = A.place_bundles(spark.createDataFrame(rows, "turn_id string, bundle_ord long, kind string, id string"), {"object": 1, "unit": 3}, Scratch(spark)).orderBy("bundle_ord").collect()
    assert [(r.placed, r.added) for r in placed] == [(True, 2), (True, 1), (False, 0), (True, 0)]


def test_report_on_no_operations(spark):
    ops = spark.createDataFrame([], "plan_id string, operation_id string, status string, required boolean, surface_id string, exhaustive boolean, depth long, range_start string, range_end string")
    assert Q.overall_status(ops).count() == Q.coverage_facts(ops).count() == 0


def test_log_faults_report_the_first(spark):
    rows = [("x", 0, 1, 0), ("x", 1, 5, 1), ("x", 2, 3, 9), ("y", 0, 1, 0)]
    log = spark.createDataFrame(rows, "thread_id string, ordinal long, sequence long, prior_state_version long")
    assert [tuple(r) for r in derived.log_faults(log).collect()] == [("x", 1, "accepted_entry_sequence_mismatch")]
