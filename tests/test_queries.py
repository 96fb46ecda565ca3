"""Native queries against their SQL in DuckDB."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "documents pages labels conversations".split()
NAMES = (
    "parse_paragraphs split_sentences r01_burstiness r02_ending_runs r08_repeated_leads r10_cleft r13_top_leads r14_duplicate_sentences r20_mixed_style md_line_blocks s06_bold_label_list s11_enumeration_mismatch "
    "p05_counts p11_counts html_visible_text suppress_apply rule_summary_rollup calibrate_rates diff_findings custom_rules r18_nominal_lists"
).split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("" if r[k] is None else f"{r[k]:.3f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from prosemill.plans.catalogue import ORACLES, QUERIES

    got, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    result = rows(got.columns, [tuple(r) for r in got.collect()])
    assert result and result == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_benchmark_times_all_operators():
    import __spark_entry__
    import bench

    assert len(bench.HEADLINE) == 24 and {q for q in __spark_entry__.queries() if q.startswith("op")} <= set(bench.HEADLINE)


def test_differences_of_urls_and_dates(spark, monkeypatch):
    import re
    from collections import Counter

    from prosemill.plans import report_queries
    from prosemill.plans.catalogue import QUERIES

    before = [(1, "https://a.example/x と https://a.example/x と http://b.example 2024年1月5日 2024年1月5日 3月4日"), (2, "2023-10-11 https://c.example/y"), (3, None)]
    after = [(1, "https://a.example/x 2024年1月5日 2025-02-03"), (2, "2023-10-11 https://c.example/z"), (4, "http://d.example 5月6日")]
    kind = "doc_id bigint, text string"
    monkeypatch.setattr(report_queries, "_facts_before", lambda s, d: spark.createDataFrame(before, kind))
    monkeypatch.setattr(report_queries, "_facts_after", lambda s, d: spark.createDataFrame(after, kind))

    def brute(rows):
        n = Counter()
        for i, t in rows:
            n.update((i, "url", u) for u in re.findall(r"https?://\S+", t or ""))
            found = re.findall(r"(?:(\d{4})[年-])?(\d{1,2})[月-](\d{1,2})", re.sub(r"https?://\S+", " ", t or ""))
            n.update((i, "date", f"{y or '-'}-{int(m):02d}-{int(d):02d}") for y, m, d in found)
        return n

    b, a = brute(before), brute(after)
    want = set()
    for x in b | a:
        if a[x] < b[x] if x[1] == "date" else b[x] and not a[x]:
            want.add((*x, "removed", False))
        elif not b[x]:
            want.add((*x, "added", x[1] == "date"))
    got = QUERIES["diff_fact_urls_dates"](spark, DATA).select("doc_id", "kind", "key", "status", "suspicious").collect()
    assert len(got) == len(want) == 8 and set(map(tuple, got)) == want
