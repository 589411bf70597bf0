import hashlib
import random

import pytest

from spanwright.llm.warc import archive, blocks_of, fetch, keys, look_up, make_record, parse_record, read_archive, url_key


def rows():
    r = random.Random(6)
    texts = ["".join(r.choice("<p>abcé 😀\r\n") for _ in range(n)) for n in (0, 5, 99, 100, 101, 2000, 2000, 300)] + ["é" * 50, "é" * 49 + "a"]
    out = [(k, r.choice([f"http://www.Example{k % 7}.org/en/{k % 5}?q=1#top", f"https://a.b{k % 3}.com", None, "no scheme", "http://x y\t/\n%41"]), r.choice(texts)) for k in range(150)]
    out += [(200, "http://hot.net/", None), (7, "http://again.net/", texts[5]), (7, "http://again.net/", texts[5]), (None, "http://null.net/", texts[5]), (None, None, "only null id " * 20), (None, None, "only null id " * 20), (300, "http://long.net/", "word " * 200000)]
    return out


def want(data):
    out = []
    for i, _, h in data:
        payload = (h or "").encode()
        same = [j for j, _, g in data if (g or "").encode() == payload and j is not None]
        ref = min(same) if len(payload) >= 100 and same and min(same) != i else None
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if ref is None else "revisit", ref))
    return out


@pytest.mark.parametrize("lines", [1, 7, 512])
def test_round_trip(spark, lines):
    data = rows()
    pages = spark.createDataFrame([(*x, "clash") for x in data], "page_id bigint, url string, html string, digest string").repartition(5)
    folder, directory = archive(pages, lines=lines)
    key = lambda x: (str(x[0]), x[2], x[3])
    assert sorted(map(tuple, read_archive(folder, directory).collect()), key=key) == sorted(want(data), key=key)
    assert directory.agg({"n": "sum"}).first()[0] == len(data)
    assert sorted(map(tuple, fetch(folder, directory, keys(pages)).collect()), key=key) == sorted(want(data), key=key)
    some = spark.createDataFrame([(url_key(u),) for u in ("http://again.net/", "http://absent.org/", None, "zzz")], "key string").repartition(3)
    assert sorted(str(r.page_id) for r in fetch(folder, directory, some).collect()) == sorted(str(i) for i, u, _ in data if u in ("http://again.net/", None))
    for url in ("http://again.net/", "http://hot.net/", "https://a.b1.com", "http://x y\t/\n%41", "http://absent.org/"):
        got = look_up(spark, folder, directory, [url, "http://other.absent/"])
        ids = sorted(str(r["page_id"]) for r in got[url])
        assert ids == sorted(str(i) for i, u, _ in data if u is not None and url_key(u) == url_key(url))
        assert got["http://other.absent/"] == []
        assert all(r["url"] == url for r in got[url])


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder, directory = archive(pages)
    assert read_archive(folder, directory).count() == fetch(folder, directory, keys(pages)).count() == 0 and look_up(spark, folder, directory, ["http://a/"]) == {"http://a/": []}


def test_records():
    assert url_key("http://M.Example.org/A?b#c") == "org,example,m)/A?b" and url_key(None) == "" and url_key("http://a.b") == "b,a)/"
    body = b"\r\n\r\nWARC/1.1\r\n\r\n"
    digest = hashlib.sha256(body).hexdigest()
    back = parse_record(make_record(3, "http://a/\r\nx", body, digest, None))
    assert back["payload"] == body and back["url"] == "http://a/\r\nx" and back["refers_to"] is None
    assert parse_record(make_record(4, None, body, digest, 3))["length"] == len(body)
    with pytest.raises(ValueError):
        parse_record(make_record(3, "u", body, digest, None).replace(body, body[:-1] + b"x"))


def test_look_up_of_a_hot_url_with_a_later_key(spark):
    data = [(k, "http://hot.net/", f"page {k}") for k in range(40)] + [(100, "http://hot.net/z", "later"), (101, "http://hot.net/zz", "last")]
    folder, directory = archive(spark.createDataFrame(data, "page_id bigint, url string, html string"), lines=3)
    # The directory's rows may come in any order.
    for by in (directory.last_key.asc(), directory.last_key.desc()):
        got = look_up(spark, folder, spark.createDataFrame(directory.orderBy(by).collect(), directory.schema).coalesce(1), ["http://hot.net/", "http://hot.net/z", "http://hot.net/zz"])
        assert {u: sorted(r["page_id"] for r in found) for u, found in got.items()} == {"http://hot.net/": list(range(40)), "http://hot.net/z": [100], "http://hot.net/zz": [101]}


def test_only_blocks_that_may_hold_a_key_are_read(spark):
    data = [(k, f"http://h{k:04d}.net/", f"page {k}") for k in range(500)] + [(1000 + k, "http://hot.net/", f"hot {k}") for k in range(300)]
    folder, directory = archive(spark.createDataFrame(data, "page_id bigint, url string, html string"), lines=10)
    asked = spark.createDataFrame([(url_key(u),) for u in ("http://h0007.net/", "http://h0008.net/", "http://hot.net/", "http://none.net/")], "key string")
    found = blocks_of(folder, directory, asked).collect()
    assert 31 <= len(found) <= 36 and directory.count() >= 80
    spread = {(b.file, b.offset) for b in found if url_key("http://hot.net/") in b["keys"]}
    assert 30 <= len(spread) <= 34
    assert sorted(r.page_id for r in fetch(folder, directory, asked).collect()) == [7, 8, *range(1000, 1300)]
