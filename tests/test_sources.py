import gzip
import tempfile

import pytest

from termweave.functions import text as T
from termweave.operators import explorer, graph, linkage, normalize, resolve, retrieve
from termweave.plans import gateway, stages
from termweave.sources import obo, records
from termweave.streaming.landing import plan_landed


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def put(path, text):
    with (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")) as f:
        f.write(text)
    return path


OBO = """format-version: 1.2

[Term]
id: X:1
name: Blood
def: "Red \\"fluid\\"." [a:b]
synonym: "sanguis" EXACT []
xref: Y:9 {source="z"}
is_a: X:2 ! top
is_a: X:3 {gci_relation="part_of"}
relationship: part_of X:4 ! body
property_value: color "red" xsd:string

[Term]
id: X:5
name: old
is_obsolete: true

[Typedef]
id: part_of
"""


def test_obo(spark, folder):
    for path in (put(f"{folder}/a.obo", OBO), put(f"{folder}/a.obo.gz", OBO)):
        (t,) = obo.terms(spark, path).collect()
        assert (t.id, t.prefix, t.name, t.definition, t.is_a, t.part_of, t.xrefs) == ("X:1", "X", "Blood", 'Red \\"fluid\\".', ["X:2"], ["X:4"], ["Y:9"])
        assert [tuple(s) for s in t.synonyms] == [("sanguis", "EXACT")] and [tuple(p) for p in t.properties] == [("color", "red")]


def test_jsonl(spark, folder):
    path = put(f"{folder}/a.jsonl.gz", '{"record_id":"a","x":1}\n\n{bad\n{"record_id":"b","x":2}\n')
    rows = records.read_jsonl(spark, path, "record_id string, x int")
    assert sorted(r.record_id for r in rows.collect()) == ["a", "b"]
    assert records.read_jsonl(spark, path, "record_id string, x int", spark.createDataFrame([("b",)], "record_id string")).collect()[0].x == 2
    records.write_jsonl(spark.createDataFrame([(2, None), (1, "a")], "n int, t string"), f"{folder}/out", "n")
    assert [r.value for r in spark.read.text(f"{folder}/out").orderBy("value").collect()] == ['{"n":1,"t":"a"}', '{"n":2,"t":null}']


@pytest.mark.parametrize(("line", "what"), [('{"a":1,"a":2}', "twice"), ('{"a":NaN}', "JSON"), ('{"a":[1e400]}', "finite"), ("[1]", "object"), ("[" * 31 + "]" * 31, "object"), ('{"a":' + "[" * 31 + "]" * 31 + "}", "deep"), ('{"run_id":3,"record_id":"a"}', "run_id")])
def test_strict_import_refuses(spark, folder, line, what):
    path = put(f"{folder}/a.jsonl", '﻿{"record_id":"a","run_id":"r","s":"1e400 ["}\n\n' + line + "\n")
    with pytest.raises(ValueError, match=f"line 3: .*{what}"):
        records.strict_import(spark, path, ["record_id", "run_id"] if what == "run_id" else [])


def test_strict_import_takes_all(spark, folder):
    path = put(f"{folder}/a.jsonl", '﻿{"record_id":"a"}\n\n{"record_id":"b"}\n')
    assert [(r.line, r.payload) for r in records.strict_import(spark, path, ["record_id"]).collect()] == [(1, '{"record_id":"a"}'), (3, '{"record_id":"b"}')]
    with pytest.raises(ValueError, match="more than 1 rows"):
        records.strict_import(spark, path, most_rows=1)


def test_an_import_holds_500_fields(spark, folder):
    """Counted over all lines; the line that has the next one is named, wherever tasks begin."""
    line = lambda names: "{" + ",".join(f'"{n}":1' for n in names) + "}"
    names = [f"f{i}" for i in range(500)]
    rows = [line(names[i : i + 10]) for i in range(0, 500, 10)] + [line(names[:400])] * 40 + ['{"f0":{},"f1":[{"new":1}]}']
    ok = put(f"{folder}/ok.jsonl", "\n".join(rows) + "\n")
    assert records.strict_import(spark, ok).count() == len(rows)
    for extra in ('{"f0":{"f1":1}}', '{"f/0":1}', '{"g":{}}'):
        path = put(f"{folder}/bad.jsonl", "\n".join([*rows, extra, line(["another"]), "no json"]) + "\n")
        with pytest.raises(ValueError, match=f"line {len(rows) + 1}: more than 500 fields"):
            records.strict_import(spark, path)
    path = put(f"{folder}/both.jsonl", "\n".join([*rows, "no json", '{"g":1}']) + "\n")
    with pytest.raises(ValueError, match=f"line {len(rows) + 1}: no JSON"):
        records.strict_import(spark, path)
    # in many tasks, whose lines do not follow one another
    lines = spark.createDataFrame([(i, line([f"k{i % 600}"])) for i in range(3000)], "line long, payload string").repartition(9)
    found = records.first_fields(lines).collect()
    assert [(r.field, r.line) for r in found] == [(f"/k{i}", i) for i in range(501)]


def test_links_and_accessions(spark, folder):
    links = records.read_links(spark, put(f"{folder}/l.tsv", "a\tx\ty\na\tz\tw\n"), 3)
    assert [(r.key, r.target) for r in links.orderBy("pos").collect()] == [("a", "y"), ("a", "w")]
    assert {r.accession for r in records.read_accessions(spark, put(f"{folder}/a.tsv", "h\tk\n1\tA\n2\t\n3\tB\n"), 2).collect()} == {"A", "B"}
    assert {r.accession for r in records.read_accessions(spark, put(f"{folder}/a.json", '{"k":{"0":"A","1":""},"z":{}}'), "k").collect()} == {"A"}


def test_normalize(spark):
    row = '{"genome":{"accession":"GCA_1.1"},"bvbrc":{"disease":["flu","","cold"],"host_name":" "},"biosamples":[{"accession":"SAMN1","attributes":[{"name":"host","value":"x"},{"harmonized_name":"host","value":"human"},{"name":"env_medium","value":null}]}]}'
    df = spark.read.json(spark.sparkContext.parallelize([row, '{"genome":{}}']))
    a, b = sorted(normalize.flat(df).collect(), key=lambda r: r.record_id)
    assert (a.record_id, a.host, a.disease, a.environment, a.bioproject_title) == ("GCA_1.1", "human", "flu; cold", None, None)
    assert b.record_id.startswith("unknown_") and b.host is None


def test_pointers_stay_distinct(spark):
    df = spark.createDataFrame([(1, '{"a.b":1,"a/b":2,"a":{"b":3,"":null},"e":{},"l":[1,2]}')], "record_id int, payload string")
    assert {(r.field, r.kind, r.value) for r in explorer.leaves(df).collect()} == {("/a.b", "number", "1"), ("/a~1b", "number", "2"), ("/a/b", "number", "3"), ("/a/", "null", None), ("/e", "json", "{}"), ("/l", "json", "[1,2]")}


def test_filters_are_checked(spark):
    with pytest.raises(ValueError, match="finite"):
        explorer.condition("gt", "inf", True)
    with pytest.raises(ValueError, match="20"):
        explorer.Query(filters=[("/a", "eq", 1)] * 21).select(None, None, {})
    with pytest.raises(ValueError, match="unknown"):
        explorer.Query(filters=[("/a", "like", 1)]).select(None, None, {"/a": ["text"]})


def test_zero_vectors_and_l2(spark):
    t = spark.createDataFrame([("o", 1, [0.0, 0.0]), ("o", 2, [1.0, 0.0]), ("o", 3, None)], "ontology string, id int, embedding array<float>")
    assert [(r.query_id, r.term_id, r.score) for r in retrieve.nearest(t, t, 5).orderBy("query_id", "rank").collect()] == [(1, 1, 0.0), (1, 2, 0.0), (2, 2, 1.0), (2, 1, 0.0)]
    assert [(r.query_id, r.term_id, r.score) for r in retrieve.nearest(t, t, 1, "l2").orderBy("query_id").collect()] == [(1, 1, 0.0), (2, 2, 0.0)]
    with pytest.raises(ValueError, match="metric"):
        retrieve.nearest(t, t, 1, "other")


def test_scalars(spark):
    rows = spark.createDataFrame([("https://www.ncbi.nlm.nih.gov/nuccore/ABC01.2?x", "https://doi.org/10.1234/Ab", "PMID: 12", "a~b/c")], "u string, d string, p string, k string")
    got = rows.select(T.wgs_accession(rows.u), T.publication(rows.d), T.publication(rows.p), T.pointer_escape(rows.k), T.fingerprint(T.F.lit('{"b":1,"a":2}')) == T.fingerprint(T.F.lit('{"a":2,"b":1}'))).first()
    assert tuple(got) == ("ABC01", "DOI:10.1234/ab", "PMID:12", "a~0b~1c", True)


def test_invented_terms_and_graph(spark):
    terms = spark.createDataFrame([("r", "A:1"), ("r", "A:2")], "record string, term_id string")
    assert [r.term_id for r in resolve.invented(terms, terms.where("term_id = 'A:1'")).collect()] == ["A:2"]
    p = spark.createDataFrame([("a", "a", "MONDO", "MONDO:1", ["MONDO:1"]), ("a", "b", "MONDO", "MONDO:1", ["MONDO:1"]), ("a", "a", "MONDO", "MONDO:2", ["MONDO:1"])], "record_id string, proposal_record_id string, ontology string, term_id string, candidate_curies array<string>")
    assert graph.proposed_disease(p).count() == 1
    o = spark.createDataFrame([("0012", "E. coli"), ("x", " E. Coli "), (None, "")], "t string, n string")
    assert [r[0] for r in o.select(graph.organism(o.t, o.n)).collect()] == ["NCBITaxon:12", "name:e. coli", None]


def test_stages_and_gateway(spark, folder):
    double = stages.Stage("b", ("a",), lambda s, a: a.selectExpr("id * 2 as id"))
    again = stages.Stage("c", ("b",), lambda s, b: b.selectExpr("id + 1 as id"))
    made = stages.run(spark, [double, again], folder, {"a": spark.range(3)})
    assert sorted(r.id for r in made["c"].collect()) == [1, 3, 5]
    assert stages.missing(stages.chosen([double, again], only="c"), {"a"}) == ["b"]
    with pytest.raises(ValueError, match="unknown stage"):
        stages.chosen([double], start="z")
    gateway.register(spark, {"made_c": f"{folder}/c"})
    assert gateway.ask(spark, "select * from made_c where id > 1;", 1).count() == 1
    assert gateway.describe(spark, "made_c").count() == 1
    for bad in ("drop view made_c", "select 1; select 2"):
        with pytest.raises(ValueError, match="allowed"):
            gateway.ask(spark, bad)


def test_landing(spark, folder):
    put(f"{folder}/in.jsonl", '{"record_id":"a","tissue":"lung"}\n')
    import os

    os.makedirs(f"{folder}/land")
    os.rename(f"{folder}/in.jsonl", f"{folder}/land/1.jsonl")
    plan_landed(spark, f"{folder}/land", "record_id string, tissue string", f"{folder}/out", f"{folder}/state").awaitTermination(60)
    (r,) = spark.read.parquet(f"{folder}/out").collect()
    assert [tuple(m) for m in r.mappings] == [("UBERON", "tissue", "lung")] and r.flags == []


def test_star_join_keeps_order_and_drops_dangling(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "bk string, v int")
    links = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 3, "x"), (1, 0, "gone")], "key int, pos int, target string")
    rows = {r.k: r.bs for r in linkage.star_join(a, "k", {"bs": (b, "bk", links)}).collect()}
    assert [x.bk for x in rows[1]] == ["y", "x", "x"] and rows[2] is None
