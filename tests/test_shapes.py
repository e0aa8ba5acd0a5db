"""Queries over masks and primitives don't make a row for each pair of them, and hold on repeated and missing keys."""

import duckdb
import pytest
from conftest import SF, TABLES, table_of

from terravane.operators import assoc, shapes
from terravane.plans.all_queries import ORACLES, QUERIES
from terravane.plans.registry import Relations
from terravane.plans.scene import patches_of_pixels
from terravane.plans.spatial import mask_shapes, pixels_of
from terravane.storage import materialise
from terravane.streaming import fold

#: query -> most rows that a step may have on 20 copies of the tables
STEPS = {
    "argmax_label": 40_000,
    "intersection_card": 40000,
    "assign_labels": 40000,
    "bank_match": 200000,
    "mask_feature_mean": 15000,
    "update_bank": 40000,
}

#: query whose rows are the pairs themselves -> most rows of a shuffle on 20 copies of the tables
SHUFFLED = {
    "radius_join": 20_000,
    "pixel_lookup": 30_000,
    "bank_union": 30_000,
    "front_topk": 40_000,
}

#: queries whose rows are pairs of primitives and masks -> most bytes of a row in files
WRITTEN = {"bank_union": 0.5, "pixel_lookup": 0.5, "front_topk": 0.5}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """20 copies of parts and events with shifted keys."""
    return write(tmp_path_factory.mktemp("copies"), *[f"SELECT t.* REPLACE ({k} + i * {n} AS {k}) FROM '{SF}/{t}.parquet' t, (SELECT unnest(range(0, 20)) AS i) c" for t, k, n in (("part", "p_partkey", 200), ("events", "event_id", 1000))])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Parts twice, also with other sizes, or without size or key; events twice, also of other users, or without id or user."""
    part = f"SELECT * FROM '{SF}/part.parquet' UNION ALL SELECT * REPLACE (p_size + 3 AS p_size) FROM '{SF}/part.parquet' WHERE p_partkey % 5 = 0 UNION ALL SELECT * FROM '{SF}/part.parquet' WHERE p_partkey % 7 = 0 UNION ALL SELECT * REPLACE (NULL::INTEGER AS p_size) FROM '{SF}/part.parquet' WHERE p_partkey % 11 = 0 UNION ALL SELECT * REPLACE (NULL::BIGINT AS p_partkey) FROM '{SF}/part.parquet' WHERE p_partkey < 3 UNION ALL SELECT * REPLACE (p_partkey + 1000 AS p_partkey) FROM '{SF}/part.parquet'"
    events = f"SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT * REPLACE (user_id + 1 AS user_id, value / 2 AS value) FROM '{SF}/events.parquet' WHERE event_id % 3 <> 0 UNION ALL SELECT * FROM '{SF}/events.parquet' WHERE event_id % 6 = 0 UNION ALL SELECT * REPLACE (NULL::BIGINT AS event_id) FROM '{SF}/events.parquet' WHERE event_id < 4 UNION ALL SELECT * REPLACE (NULL::BIGINT AS user_id) FROM '{SF}/events.parquet' WHERE event_id < 4"
    return write(tmp_path_factory.mktemp("odd"), part, events)


def write(folder, part, events):
    for t in TABLES:
        sql = {"part": part, "events": events}.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def most_rows(df, metric="numOutputRows"):
    """Rows of the largest step of a query that has run."""

    def walk(node):
        yield node
        inner = [node.children().apply(i) for i in range(node.children().length())]
        kind = node.getClass().getSimpleName()
        inner += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        for n in inner:
            yield from walk(n)

    counts = [n.metrics().get(metric) for n in walk(df._jdf.queryExecution().executedPlan())]
    return max(c.get().value() for c in counts if c.isDefined())


@pytest.mark.parametrize("name", sorted(STEPS))
def test_no_step_has_a_row_for_each_pair(spark, copies, name):
    df = QUERIES[name](spark, copies)
    df.collect()
    assert most_rows(df) <= STEPS[name]


@pytest.mark.parametrize("name", sorted(SHUFFLED))
def test_pairs_are_not_shuffled(spark, copies, name):
    df = QUERIES[name](spark, copies)
    df.collect()
    assert most_rows(df, "shuffleRecordsWritten") <= SHUFFLED[name]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """20000 masks of 63 shapes and 50 primitives, all on one pixel of view 1."""
    part = f"SELECT t.* REPLACE (1 + 280 * i AS p_partkey, (i % 63)::INTEGER AS p_size) FROM (SELECT * FROM '{SF}/part.parquet' LIMIT 1) t, (SELECT unnest(range(0, 20000)) AS i) c"
    place = "SELECT min(e) FROM (SELECT unnest(range(0, 1920)) AS e) r WHERE (e * 7919) % 640 BETWEEN 280 AND 310 AND (e * 104729) % 480 BETWEEN 160 AND 190"
    events = f"SELECT t.* REPLACE (1920 * i + ({place}) AS event_id, 1::BIGINT AS user_id) FROM (SELECT * FROM '{SF}/events.parquet' LIMIT 1) t, (SELECT unnest(range(0, 50)) AS i) c"
    return write(tmp_path_factory.mktemp("crowded"), part, events)


@pytest.mark.parametrize("name", sorted(WRITTEN))
def test_rows_of_pairs_are_written_small(spark, crowded, name, tmp_path):
    """The order of the rows suits columnar files, where a pair takes a small part of its 16 bytes or more."""
    QUERIES[name](spark, crowded).write.parquet(f"{tmp_path}/rows")
    rows, files = spark.read.parquet(f"{tmp_path}/rows").count(), tmp_path.glob("rows/*.parquet")
    assert rows >= 400_000 and sum(f.stat().st_size for f in files) <= WRITTEN[name] * rows


@pytest.mark.parametrize("name", sorted({**STEPS, **SHUFFLED}))
def test_odd_keys_give_what_the_sql_says(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    df = QUERIES[name](spark, odd)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert table_of(df.select(cols).collect(), cols) == table_of(rel.select(*[f'"{c}"' for c in cols]).fetchall(), cols)


@pytest.fixture(scope="module")
def recurring(tmp_path_factory):
    """Each event in two or three views, also at other depths or without one."""
    events = f"SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT * REPLACE (user_id + 1 + event_id % 5 AS user_id, value * 0.9 AS value) FROM '{SF}/events.parquet' UNION ALL SELECT * REPLACE (user_id + 6 AS user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value) FROM '{SF}/events.parquet' WHERE event_id % 3 = 0"
    return write(tmp_path_factory.mktemp("recurring"), f"SELECT * FROM '{SF}/part.parquet'", events)


ASSOCIATIONS = ["associate", "stateful_fold"]


@pytest.mark.parametrize("name", ASSOCIATIONS)
def test_association_writes_no_row_for_each_pair(spark, copies, name, monkeypatch):
    counts = []

    def counting(df):
        counts.append(df.count())
        return materialise(df)

    for module in (assoc, shapes, fold):
        monkeypatch.setattr(module, "materialise", counting)
    rows = QUERIES[name](spark, copies).collect()
    assert len(rows) == len({r["label"] for r in rows}) == 4000 and max(counts) <= 40_000


@pytest.mark.parametrize("name", ASSOCIATIONS)
@pytest.mark.parametrize("data", ["odd", "recurring"])
def test_association_of_odd_keys_gives_what_the_sql_says(spark, data, name, request):
    test_odd_keys_give_what_the_sql_says(spark, request.getfixturevalue(data), name)


def test_fold_of_frames_goes_on_after_a_restart(spark, recurring, tmp_path):
    """Each batch by a new object, one of them twice: the same labels as of all views at once; a view lies in one batch."""
    r, folder = Relations(spark, recurring), f"file://{tmp_path}/bank"
    points, members = pixels_of(r).filter("view < 4"), mask_shapes(r).filter("view < 4")
    want = {tuple(x) for x in assoc.associate_shapes(points, shapes.numbered(members), 0.5, *patches_of_pixels(), 0.1)[0].collect()}
    seen = fold.frames(points, members)

    def add(views, batch):
        fold.ShapeFold(spark, folder, 0.5, *patches_of_pixels(), 0.1).add(seen.filter(views), batch)

    for views, batch in (("view < 2", 0), ("view = 2", 1), ("view = 2", 1), ("view = 3", 2)):
        add(views, batch)
    rows = [tuple(x) for x in fold.ViewFold(spark, folder).labels.collect()]
    assert set(rows) == want and len(rows) == len(want) and len({x[2] for x in rows}) < len(rows)
    with pytest.raises(ValueError, match="two batches"):
        add("view = 2", 3)
