"""The driver's contract: every query against its SQL at the smallest scale."""

import decimal
import difflib
import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from skein.plans import catalog, queries

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return x.isoformat() if hasattr(x, "isoformat") else float(x) if isinstance(x, (float, decimal.Decimal)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in frame.select(*columns).collect()) == expected


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["query_id", "group_pos", "pos", "source_id", "passage_id", "sequence", "kwic", "citation", "matched_by_synonym"]
    assert not frame.isEmpty()


def test_registered():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(catalog.queries()) <= set(entry_module.queries())
    assert set(catalog.queries()) - set(SQL) == {"raw_scan"}


def test_python_only_queries_run(spark):
    parts = queries.split_long(spark, SF).toPandas()
    whole = queries.tx.n_words(queries.F.coalesce(queries.F.col("text"), queries.F.lit("")))
    sizes = {r.doc_id: r.n for r in queries.ad.table(spark, SF, "documents").select("doc_id", whole.alias("n")).collect()}
    assert parts.groupby("doc_id")["n_words"].sum().to_dict() == {k: v for k, v in sizes.items() if v}
    best = {r.name: (r.status, r.suggested_source_id) for r in queries.raw_scan(spark, SF).collect()}
    known = [(r.id, r.title, r.short_title, r.sort_order) for r in queries.ad.sources(spark, SF).collect()]
    assert best == {name: by_hand(name, known) for name in queries.RAW_FILES}


def by_hand(name, known):
    """The status and source of a raw file, by plain loops."""
    slug = lambda x: re.sub("[^a-z0-9]+", "-", x.lower()).strip("-")
    tokens = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
    raw, scored = slug(name.rsplit(".", 1)[0]), []
    for id_, title, short, order in known:
        ratio = max(difflib.SequenceMatcher(None, raw, x).ratio() for x in (slug(id_), slug(title or short)))
        scored.append((-(ratio * 100 + 8 * len(tokens(raw) & tokens(f"{slug(id_)} {slug(title)} {id_} {title} {short}"))), order, id_))
    score, _, id_ = min(scored)
    if raw == slug(id_) or raw in slug(id_) or slug(id_) in raw or -score >= 75:
        return "existing", id_
    return "new", raw or "new-source"
