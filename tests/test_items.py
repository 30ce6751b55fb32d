"""Streamed item ingest: raw upserts, clean inserts, scores, counts and batches that run again."""

import datetime as dt

import numpy as np

from marketloom.sources import news
from marketloom.streaming import ingest, items

AT = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, external_id string, content_sha256 string, published_at timestamp, title string, summary string, url string, text_for_score string, row_seq long, source string"


def model():
    return lambda texts: np.array([float(len(t)) for t in texts])


def item(external, sha, seq, title="t", text="abc", source="a", at=AT):
    return ("A", external, sha, at, title, None, None, text, seq, source)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_batches(spark, tmp_path):
    store = items.NewsStore(spark, str(tmp_path), model)
    store.add(frame(spark, item("1", "x", 1), item("1", "y", 2, "u" * 9000), item("2", "x", 3, text="late copy"), item("1", "z", 4, source="b", text=" ")), 0)
    raw = lambda: sorted((r.source, r.external_id, r.content_sha256) for r in store.raw().collect())
    clean = lambda: sorted((r.content_sha256, r.row_seq, r.score, len(r.title)) for r in store.clean().collect())
    assert raw() == [("a", "1", "y"), ("a", "2", "x"), ("b", "1", "z")]
    assert clean() == [("x", 1, 3.0, 1), ("y", 2, 3.0, 8000), ("z", 4, None, 1)]
    second = frame(spark, item("1", "x", 5, text="again"), item("3", "w", 6))
    for _ in range(2):  # a batch that runs again replaces itself
        store.add(second, 1)
        assert raw() == [("a", "1", "x"), ("a", "2", "x"), ("a", "3", "w"), ("b", "1", "z")]
        assert [c[:2] for c in clean()] == [("w", 6), ("x", 1), ("y", 2), ("z", 4)]
        assert sorted(tuple(r[c] for c in ("batch", "items", "raw_added", "clean_added", "scored")) for r in store.counts().collect()) == [(0, 4, 3, 3, 2), (1, 2, 1, 1, 1)]
    store.add(second.limit(0), 2)
    assert len(raw()) == 4 and len(clean()) == 4 and store.counts().count() == 2


def test_deliveries_that_come_again(spark, tmp_path):
    store = items.NewsStore(spark, f"{tmp_path}/news")
    old = item("9", "old", 9, at=AT - dt.timedelta(days=400))
    for rows in ([item("1", "x", 1), item("2", "y", 2)], [item("1", "x", 3), item("2", "changed", 4), old]):
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        items.run(ingest.files(spark, f"{tmp_path}/landed", frame(spark).schema), store, f"{tmp_path}/offsets")
    # the unchanged item is dropped, the changed one replaces its raw row, an old date is not late
    assert {r.external_id: (r.content_sha256, r.row_seq) for r in store.raw().collect()} == {"1": ("x", 1), "2": ("changed", 4), "9": ("old", 9)}
    assert sorted(r.content_sha256 for r in store.clean().collect()) == ["changed", "old", "x", "y"] and store.clean().where("score is not null").count() == 0
    assert sum(r["items"] for r in store.counts().collect()) == 4


def test_providers_in_order(spark):
    first, second = frame(spark, item("1", "x", 5), item("1", "y", 6)), frame(spark, item("1", "x", 1, "second"), item("2", "x", 2), item("2", "x", 3))
    found, counts = items.united([first, second])
    assert sorted((r.external_id, r.content_sha256, r.provider, r.row_seq) for r in found.collect()) == [("1", "x", 0, 5), ("1", "y", 0, 6), ("2", "x", 1, 2)]
    assert sorted(map(tuple, counts.select("provider", "fetched", "kept").collect())) == [(0, 2, 2), (1, 3, 1)] and set(news.ITEM) < set(found.columns)
    assert items.united([first.limit(0), second.limit(0)])[0].collect() == []
