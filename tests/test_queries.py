"""Every registered query against its SQL twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from marketloom import catalogue
from tests.compare import same_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    frame = catalogue.QUERIES[name](spark, SF_DIR)
    if name in catalogue.ORACLE_SQL:
        same_rows(frame, catalogue.ORACLE_SQL[name], SF_DIR)
    else:
        assert frame.columns and frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["symbol", "day"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_combined_news_holds_documents_without_text(spark, tmp_path):
    for file in Path(SF_DIR).iterdir():
        if file.name != "documents.parquet":
            (tmp_path / file.name).symlink_to(file)
    without = "SELECT doc_id + 100000 + k, [NULL, '', '  '][k], lang, source, 0 FROM documents CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE doc_id % 5 = 0 AND doc_id % 7 = k"
    duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'; COPY (SELECT * FROM documents UNION ALL {without}) TO '{tmp_path}/documents.parquet'")
    for name in ("u02_combined_news", "s03_mapped_news"):
        same_rows(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLE_SQL[name], str(tmp_path))
