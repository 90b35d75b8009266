"""What the evidence graph takes from records, where it says it was read, and what it leaves out."""

import json

import pytest

from termweave import catalog
from termweave.operators import evidence, graph
from termweave.operators import explorer as X
from termweave.operators import linkage as L
from termweave.operators import resolve as R

#: One record for each rule, told apart by its place in the list.
CASES = {
    # an assembly list: the second's accession is under the third name, its sample has a key alone, its twin stands below
    "assemblies": {"genomes": [{"species": "no accession"}, {"assembly_accession": "GCF_900000002.3", "assemblyInfo": {"biosample": {"_key": "SAMEA55", "taxonomy_name": " Vibrio Sp. ", "attributes": [{"name": "depth", "value": "3 m"}, {"attribute_name": "Host Disease", "value": "Cholera"}]}, "pairedAssembly": {"accession": "GCA_900000002.3"}}}]},
    # lists of accessions in one text and in a list of objects; the studies of a sample come before its one study
    "sample": {"biosample": {"accession": "SAMD31", "title": "Sea water", "bioprojects": [{"accession": "PRJDB7"}, {"_key": "PRJDB8"}, "PRJDB9;PRJDB10"], "bioproject_accession": "PRJDB11", "sra_sample": "DRS4", "id_recs": [{"db": "GenBank", "id": "SAMD99"}, {"db": "SRA", "id": ["DRS5", "DRS4"]}]}},
    # the archive's own fields: the first accession speaks, all are mentioned; a taxon that is no number leaves the name
    "bvbrc": {"bvbrc": {"accession": ["NC_000907.1", "NC_000908"], "genome_id": 562.55, "taxon_id": "n/a", "organism_name": "Haemophilus", "publication": 0, "publications": ["10.1000/xyz12, 777", {"pmid": 88, "title": "On shells"}, {"db": "doi", "id": "10.1000/Q"}, {"db": "book", "id": "5"}]}},
    "flat": {"genome.accession": "GCA_700000001", "genome.sra_accession": "ERR7,ERX8", "genome.organism": {"taxId": "0485"}, "genome.disease": ["Gonorrhea", "unknown", None]},
    "study": {"bioproject": {"_key": "PRJEB40", "niaid_programs": [{"name": "Vector Hub"}, "Vector Hub", 7, {"name": ""}]}},
    "runs": {"sra_runs": {"experiment_accession": "SRX61", "study_accession": "SRP62 SRP63"}},
    "curated": {"original_metadata": {"record_id": "ERS12", "disease": ["Measles", "x" * 301], "extras": {"taxonomy_id": None, "organism": "Measles morbillivirus", "attributes": {"host_disease": "", "disease": "Rash"}}}},
    "own terms": {"record_id": "SAMN8", "candidate_curies": ["MONDO:2", "MONDO:x", 3], "terms": [{"ontology": "MONDO", "term_id": "MONDO:1", "label": "a"}, "MONDO:2", {"ontology": "MONDO", "term_id": "MONDO:2"}, {"ontology": "MONDO", "term_id": "MONDO:x"}, {"ontology": "ENVO", "term_id": "MONDO:2"}]},
    "other record": {"source_record": {"record_id": "SAMN8"}, "proposal": {"record_id": "SAMN9", "candidate_curies": ["MONDO:2"], "terms": [{"ontology": "MONDO", "term_id": "MONDO:2"}]}},
    "text only": {"title": "SAMN77 of PRJNA5", "note": "seen in GCA_000000009.1", "extras": {"organism": "Felis"}},
    "below": {"sra_experiments": [{"accession": "ERX1"}, {"accession": "ERX2"}], "disease": "Gout", "niaid_programs": ["P"]},
    "odd": {"record_id": ["SAMN1"], "genome": "GCA_000000009.1", "biosamples": {"accession": None, "_key": True}, "bvbrc": [[{"accession": "NC_000909"}]], "terms": {}, "proposal": 3},
    "dates": {"genome": {"accession": "GCA_300000001.1", "biosample_accession": 12, "bioproject_accession": {"accession": "PRJNA3"}, "assemblyInfo": [], "organism": None, "disease": False}},
}
NAMES = list(CASES)
#: (relation, target, path, value) of all edges but those to archives, by record; sources where they are not plain.
WANT = {
    "assemblies": {
        ("sequenced from", "sample:SAMEA55", "/genomes/1/assemblyInfo/biosample/accession", "SAMEA55"),
        ("organism", "organism:name:vibrio sp.", "/genomes/1/assemblyInfo/biosample/taxonomy_name", "Vibrio Sp."),
        ("reported disease", "disease:reported:cholera", "/genomes/1/assemblyInfo/biosample/attributes/1/value", "Cholera"),
        ("paired assembly", "sequence:GCA_900000002.3", "/genomes/1/assemblyInfo/pairedAssembly/accession", "GCA_900000002.3"),
    },
    "sample": {*(("belongs to study", f"study:PRJDB{i}", "/biosample/bioprojects", f"PRJDB{i}") for i in (7, 8, 9, 10)), ("same sample identifier", "sample:DRS4", "/biosample/sra_sample", "DRS4"), ("same sample identifier", "sample:DRS4", "/biosample/id_recs/1/id", "DRS4"), ("same sample identifier", "sample:DRS5", "/biosample/id_recs/1/id", "DRS5")},
    "bvbrc": {
        ("metadata supplied by", "repository:BV-BRC", "/bvbrc", "562.55"),
        ("organism", "organism:name:haemophilus", "/bvbrc/taxon_id", "n/a"),
        ("cites", "publication:DOI:10.1000/xyz12", "/bvbrc/publications/0", "DOI:10.1000/xyz12"),
        ("cites", "publication:PMID:777", "/bvbrc/publications/0", "PMID:777"),
        ("cites", "publication:PMID:88", "/bvbrc/publications/1", "PMID:88"),
        ("cites", "publication:DOI:10.1000/Q", "/bvbrc/publications/2", "DOI:10.1000/Q"),
    },
    "flat": {("linked sequence", "sequence:ERR7", "/genome.sra_accession", "ERR7"), ("linked sequence", "sequence:ERX8", "/genome.sra_accession", "ERX8"), ("organism", "organism:NCBITaxon:0485", "/genome.organism/taxId", "0485"), ("reported disease", "disease:reported:gonorrhea", "/genome.disease", "Gonorrhea")},
    "study": {("reported NIAID program", "program:NIAID:vector hub", "/bioproject/niaid_programs", "Vector Hub"), ("reported NIAID program", "program:NIAID:7", "/bioproject/niaid_programs", "7")},
    "runs": {("belongs to study", "study:SRP62", "/sra_runs/study_accession", "SRP62 SRP63"), ("belongs to study", "study:SRP63", "/sra_runs/study_accession", "SRP62 SRP63")},
    "curated": {("organism", "organism:name:measles morbillivirus", "/original_metadata/extras", "Measles morbillivirus"), ("reported disease", "disease:reported:measles", "/original_metadata/disease", "Measles"), ("reported disease", "disease:reported:rash", "/original_metadata/extras/attributes/disease", "Rash")},
    "own terms": {("proposed disease", "disease:MONDO:2", "/terms/2", "MONDO:2")},
    "dates": {("belongs to study", "study:PRJNA3", "/genome/bioproject_accession", "")},
}
EXPLICIT, DERIVED = "explicit field", "repository derived from identifier namespace"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, i + 100, json.dumps(o)) for i, o in enumerate(CASES.values())] + [(50, 1, None), (51, 2, "{not json"), (52, 3, '["SAMN1"]'), (53, 4, '{"a": ' * 3000)]
    return spark.createDataFrame(rows, "record_id long, line long, payload string")


@pytest.fixture(scope="module")
def stated(spark, records):
    said = evidence.statements(records)
    return spark.createDataFrame(said.collect(), said.schema).coalesce(1)


@pytest.fixture(scope="module")
def evidences(stated):
    made = graph.edges(evidence.claims(stated)).collect()
    return [(e.source, e.relation, e.target, e.status, x) for e in made for x in e.evidence]


def of(evidences, name):
    return [e for e in evidences if e[4].record_id == NAMES.index(name)]


@pytest.mark.parametrize("name", NAMES)
def test_each_record_says_what_is_expected(evidences, name):
    mine = [e for e in of(evidences, name) if e[1] != "registered in"]
    assert {(r, t, x.path, x.value) for _, r, t, _, x in mine} == WANT.get(name, set())
    assert all(x.basis == EXPLICIT and x.line == x.record_id + 100 and s == ("proposed" if r == "proposed disease" else "reported") for _, r, _, s, x in mine)


def test_sources_are_the_objects_that_speak(evidences):
    sources = {name: {s for s, r, *_ in of(evidences, name) if r != "registered in"} for name in NAMES}
    assert sources["assemblies"] == {"sequence:GCF_900000002.3", "sample:SAMEA55"}
    assert sources["bvbrc"] == {"sequence:NC_000907.1"} and sources["curated"] == {"sample:ERS12"} and sources["runs"] == {"sequence:SRX61"}


def test_archives_rest_on_the_form_of_an_identifier(evidences):
    lain = {(s, t): (status, x.path, x.value, x.basis) for s, r, t, status, x in of(evidences, "bvbrc") if r == "registered in"}
    assert lain["sequence:NC_000908", "repository:GenBank / RefSeq"] == ("derived", "/bvbrc/accession", "NC_000908", DERIVED)
    assert lain["publication:PMID:88", "repository:PubMed"] == ("derived", "/bvbrc/publications/1", "PMID:88", DERIVED)
    assert not any(s.startswith(("disease:", "program:")) for s, r, *_ in evidences if r == "registered in")


def test_nodes_and_their_labels(stated):
    nodes = {f"{r.type}:{r.identifier}": r for r in graph.nodes(evidence.mentions(stated)).collect()}
    assert nodes["sample:SAMD31"].label == "Sea water" and nodes["publication:PMID:88"].label == "On shells"
    assert nodes["organism:NCBITaxon:0485"].label == "Taxon 0485" and nodes["disease:MONDO:2"].label == "MONDO:2"
    assert {NAMES[i] for i in nodes["sample:SAMN8"].record_ids} == {"own terms", "other record"}
    seen = {NAMES[i] for r in nodes.values() for i in r.record_ids}
    assert seen == set(NAMES) - {"text only", "odd"}
    assert not any(k.startswith(("sequence:GCA_000000009", "sample:SAMN77", "disease:reported:gout")) for k in nodes)


def test_accounting(records, stated):
    row = evidence.accounting(records, stated).first()
    assert (row.records, row.unsupported, row.truncated) == (len(NAMES) + 4, 2 + 4, 1)


def test_bounds_count_what_a_view_leaves_out(stated):
    made, links = graph.nodes(evidence.mentions(stated)), graph.edges(evidence.claims(stated))
    nodes, edges = made.collect(), links.collect()
    shown = {f"{r.type}:{r.identifier}" for r in sorted(nodes, key=lambda r: (r.type, r.identifier))[:12]}
    inside = sum(e.source in shown and e.target in shown for e in edges)
    row = graph.bounds(made, links, 12, 2).first()
    assert tuple(row) == (len(nodes), len(nodes) - 12, len(edges), len(edges) - inside, max(inside - 2, 0))
    a, b = graph.view(made, links, 12, 2)
    assert a.count() == 12 and b.count() == min(inside, 2)


def test_hub_nodes_stay_small(spark):
    rows = spark.range(5000).selectExpr("'organism' as type", "'NCBITaxon:1' as identifier", "case when id = 7 then 'Name' end as label", "id as record_id")
    hub = graph.nodes(rows).first()
    assert hub.label == "Name" and hub.record_ids == list(range(8)) and hub.n_records == 5000


def test_plans_read_comments_and_attributes(spark):
    row = [("r", " Human ", ["from blood of a patient", None, "nothing"], {"sample_type": "skin swab", "host": "blood", "x": None})]
    df = spark.createDataFrame(row, "record_id string, isolation_source string, comments array<string>, biosample_attrs map<string,string>")
    made = R.planned(df, error="no model").first()
    assert [(m.ontology, m.path, m.query_text) for m in made.mappings] == [("MONDO", "comments[0]", "from blood of a patient"), ("UBERON", "comments[0]", "from blood of a patient"), ("UBERON", "biosample.sample_type", "skin swab")]
    assert made.flags == ["plan_agent_error: no model", "looks_like_host"]


def test_any_key_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (None, 4), (5, 6)], "a int, b int")
    wanted = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(map(tuple, L.having_any_key(df, ["a", "b"], wanted, "k").collect())) == [(1, 2), (1, 2), (3, 1)]
    with pytest.raises(ValueError, match="3 keys of b"):
        L.require_known(df, "b", wanted.where("k = 2"), "k")


def test_budget_takes_later_smaller_records(spark):
    page = spark.createDataFrame([(1, "x" * 6), (2, "x" * 9), (3, "x" * 3)], "record_id int, payload string")
    assert X.within_budget(page, ["record_id"], 10) == ([1, 3], 1)
    assert X.comment_key(["/comments", "/comments_2/x"]) == "comments_3"


def test_evidence_of_edges_is_shuffled_once_and_not_checkpointed(spark):
    df = catalog.QUERIES["graph_evidence"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of the keys that records are made of, and of claims by edge
    assert plan.count("MapInArrow") == 1 and "ExistingRDD[record_id" not in plan


def test_edges_hold_distinct_evidence_in_order(spark):
    rows = [("a", "b", "r", "s", e) for e in (3, 1, 1, 7, 2, 2, 2, 9, 5, 3)] + [("a", "a", "r", "s", 1), (None, "b", "r", "s", 1), ("a", "c", "r", "s", 4)]
    made = graph.edges(spark.createDataFrame(rows, "source string, target string, relation string, status string, evidence int").repartition(4))
    assert {r.target: r.evidence for r in made.collect()} == {"b": [1, 2, 3, 5, 7], "c": [4]}


def test_records_that_share_an_id_speak_for_themselves(spark):
    payload = lambda n: json.dumps({"genome": {"accession": f"GCA_{n}.1", "organism": {"taxId": n}}})
    said = evidence.statements(spark.createDataFrame([(1, 1, payload(5)), (1, 1, payload(6))], "record_id long, line long, payload string"))
    assert sorted((r.source_id, r.target_id) for r in said.where("relation = 'organism'").collect()) == [("GCA_5.1", "NCBITaxon:5"), ("GCA_6.1", "NCBITaxon:6")]


def test_bounds_need_the_keys_of_nodes_and_edges_alone(spark, records, stated):
    told = evidence.facts(records)
    node = lambda df: sorted((r.type, r.identifier) for r in df.collect())
    edge = lambda df: sorted((r.source, r.target, r.relation, r.status) for r in df.collect())
    assert node(graph.node_keys(evidence.mentions(told))) == node(graph.nodes(evidence.mentions(stated)))
    assert edge(graph.edge_keys(evidence.claims(told))) == edge(graph.edges(evidence.claims(stated)))
    plan = catalog.QUERIES["graph_bounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ExistingRDD" not in plan and "Window" not in plan
