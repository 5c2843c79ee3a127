"""Every text query over tables with nulls, ties, repeated rows, clashing columns, and no rows; SQL beside it where there is any."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

from driftpanel.llm.queries import ORACLES, QUERIES

CLASHES = "n long, key string, row long, found string, words long, size long, hash long, score double, seed long, at long, host string, rule string, kept string, `__llm_id` long"
CLASH = (1, "k", 2, "f", 3, 4, 5, 0.5, 6, 7, "h", "r", "x", 8)
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES,
    "benchmark": "item_id long, text string, n long, shift long, words string",
    "labels": "doc_id long, quality int, toxic int, n long",
    "conversations": "conv_id long, turn long, role string, text string, block long, phase string, fault long, copies int",
    "pages": "page_id long, url string, html string, n long, host string, path string, src string",
}
ROWS = ("op3_mix", "op4_substrings", "op5_tokens", "op6_language", "op8_simhash", "op9_rules", "op2_quality", "op12_token_store")


def _documents(null_ids: bool):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", " \t\n", "one", "½ ² 42", "Ünïcode ßtraße ÎÏ", "x" * 50_000, "many words here " * 3000]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(30)]
    texts += [passage, passage, f"before it {passage} after it", f"{passage}\n{passage}", passage.upper()]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), *CLASH) for i, t in enumerate(texts)]
    rows += rows[3:6] + [(70, passage, None, None, None, *[None] * len(CLASH)), (70, "another text", "en", "a", 3, *CLASH)]
    if null_ids:
        rows += [(None, passage, "en", "a", 3, *CLASH), (None, None, None, None, None, *[None] * len(CLASH))]
    return rows


def _write(spark, folder, null_ids: bool, empty: bool = False) -> str:
    docs = _documents(null_ids)
    item = " ".join(docs[38][1].split()[5:40])
    tables = {
        "documents": docs,
        "benchmark": [(0, item, 1, 2, "w"), (1, item, None, None, None), (2, None, 1, 1, "w"), (3, "", 1, 1, "w"), (4, "too short", 1, 1, "w"), (5, item.replace("w1 ", "zz "), 1, 1, "w")],
        "labels": [(i, q, 0, 1) for i, q in [(1, 0), (2, 0), (3, None), (10, 1), (11, 1), (12, 1), (12, 0), (13, 1), (14, 0), (99, 1), (None, 1)]],
        "conversations": [
            (c, t, r, x, 1, "p", 2, 3)
            for c, t, r, x in [
                (None, None, None, None), (None, 0, "user", "a."), (None, 1, "assistant", "b"), (1, 0, "", ""), (1, 0, "user", " "), (1, 1, "user", "long. " * 20_000),
                (1, 1, "user", "long. " * 20_000), (2, None, "system", "x!"), (2, 5, "user", "q?"), (2, 9, "assistant", "r."), (2, 9, "assistant", "s."), (3, 0, "user", "t"),
            ]
        ],
        "pages": [
            (0, None, None, 1, "h", "p", "s"), (1, "", "", 1, "h", "p", "s"), (2, "no scheme", "<p>text", None, None, None, None),
            (3, "http://A.Example.com/en/x?q#f", "<a href='http://spam.net/'>x</a><p>words and words", 1, "h", "p", "s"),
            (4, "https://spam.net/es/", "<A HREF=//www.example.com/en/>y</a>", 1, "h", "p", "s"),
            (4, "https://spam.net/es/", "<A HREF=//www.example.com/en/>y</a>", 1, "h", "p", "s"),
            (5, "http://other.org", '<a href="http://spam.net/a">z</a>', 1, "h", "p", "s"), (None, "x://h.net/fr/", None, 1, "h", "p", "s"),
        ],
    }
    for name, rows in tables.items():
        spark.createDataFrame([] if empty else rows, SCHEMAS[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), null_ids=True)


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), null_ids=False, empty=True)


@pytest.fixture(scope="module")
def known_ids(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("known"), null_ids=False)


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    ids = Counter(r[0] for r in rows)
    if name in ROWS:
        assert ids == Counter(r[0] for r in _documents(null_ids=True))
    elif name in ("op7_html", "op10_urls"):
        assert ids == Counter([0, 1, 2, 3, 4, 4, 5, None])
    elif name == "op11_collocations":
        assert set(ids) <= {"en", "de", "und"} and rows
    elif name == "op13_conversations":
        assert ids == Counter([None, 1, 2, 3])
    elif name == "op1_decontaminate":
        assert {38, 39, 40, 41, 42, 70, None} <= set(ids) and set(ids.values()) == {1}
    else:
        assert 0 not in ids and rows
    if name == "op6_language":
        # null, empty, white space, and number signs hold no letter
        assert {(r.doc_id, r.score) for r in rows if r.lang_pred == "und"} == {(i, 0.0) for i in (0, 1, 2, 4, None)}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, no_rows, odd, name):
    empty = QUERIES[name](spark, no_rows)
    assert empty.collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, known_ids, name):
    db = duckdb.connect()
    for table in SCHEMAS:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{known_ids}/{table}.parquet/*.parquet'")
    frame = QUERIES[name](spark, known_ids)
    got = Counter(tuple(r) for r in frame.collect())
    result = db.execute(ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in frame.columns]
    assert got == Counter(tuple(r[i] for i in order) for r in result.fetchall())
