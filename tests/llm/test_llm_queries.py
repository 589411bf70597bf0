"""The registered queries of the training-data operators on small tables: whole results, and oracles where SQL can say them."""

import zlib

import duckdb
import pytest

from spanwright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLE = {"op2": ("conversations", "turn"), "op6": ("pages", "page_id"), "op10": ("pages", "page_id")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_each_row_is_there(spark, duck, name):
    table, key = TABLE.get(name.split("_")[0], ("documents", "doc_id"))
    got = QUERIES[name](spark, SF)
    ids = sorted(r[0] for r in got.select(key).distinct().collect())
    assert ids == [r[0] for r in duck.execute(f"select distinct {key} from {table} order by 1").fetchall()]
    if name.split("_")[0] != "op7":
        assert got.count() == duck.execute(f"select count(*) from {table}").fetchall()[0][0]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    told = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(names)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr) == sorted((tuple(map(tidy, r)) for r in told.fetchall()), key=repr)


def test_language_on_held_out_rows(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    got = [r for r in QUERIES["op1_crf_language_id"](spark, SF).collect() if r.held_out]
    assert {r.doc_id for r in got} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
