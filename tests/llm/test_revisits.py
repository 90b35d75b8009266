import random
import re

import duckdb

from termweave.llm import revisits as V


def key(url):
    if url is None:
        return None
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", re.sub(r"#.*$", "", url.strip()))
    m = re.match(r"([^/?]*)([^?]*)(?:\?(.*))?$", rest)
    host = re.sub(r":(80|443)$", "", re.sub(r"^www[0-9]*\.", "", m[1].lower()))
    ask = sorted(p for p in (m[3] or "").split("&") if p and not re.match(V.TRACKING, p))
    return host + re.sub("/+$", "", m[2]) + ("?" + "&".join(ask) if ask else "")


def brute(rows):
    out = []
    for r in rows:
        if r["kind"] == "response":
            continue
        k, low = key(r["url"]), lambda h: {n.lower(): v for n, v in sorted((h or {}).items())}
        there = [f for f in rows if f["kind"] == "response" and k is not None and key(f["url"]) == k and None not in (f["ts"], r["ts"]) and f["ts"] < r["ts"]]
        f = max(there, key=lambda x: (x["ts"], x["record_id"]), default=None)
        weak = lambda t: t[2:] if t and t.startswith("W/") else t
        a, b = (("etag", weak) if r["etag"] is not None else ("last_modified", lambda t: t))
        verdict = "no_response" if f is None else "unverified" if r[a] is None or f[a] is None else "resolved" if b(r[a]) == b(f[a]) else "mismatch"
        new = {n: v for n, v in low(r["headers"]).items() if n not in V.KEPT}
        ok = verdict == "resolved"
        out.append((r["record_id"], k, r["ts"], verdict, f and f["record_id"], sorted((low(f["headers"]) | new).items()) if ok else None, f["digest"] if ok else None))
    return sorted(map(str, out))


SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string, stretch string"


def test_equals_brute_force(spark):
    rng = random.Random(9)
    urls = ["http://www.A.example/x/?b=1&utm_source=k&a=2#t", "https://a.example:443/x?a=2&b=1", "https://a.example/x?ref=z", "a.example/x", "http://b.example", None, ""]
    rows = []
    for i in range(400):
        rows.append({"record_id": i, "url": rng.choice(urls[:1] * 6 + urls), "ts": rng.choice([None, *range(0, 4 * V.STRETCH, V.STRETCH // 9)] * 1), "kind": rng.choice(["response", "revisit"]), "etag": rng.choice([None, '"a"', 'W/"a"', '"b"']), "last_modified": rng.choice([None, "m", "n"]), "headers": rng.choice([None, {}, {"Date": "1", "content-type": "x"}, {"DATE": "2", "X-a": "3", "Content-Length": "9"}]), "digest": str(i), "stretch": "z"})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = [(r.record_id, r.url_key, r.ts, r.verdict, r.refers_to, sorted(r.headers.items()) if r.headers is not None else None, r.digest) for r in V.resolve(df).collect()]
    assert sorted(map(str, got)) == brute(rows)
    assert V.resolve(df.limit(0)).collect() == []
    assert len(V.resolve(df.unionAll(df)).collect()) == 2 * len(got)


def test_sql_states_the_same(spark):
    sf = "/root/testdata/sf0.01"
    got = V.op10_warc_revisits(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(V.OP10_SQL).fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want)) and len({r[3] for r in rows}) == 4
