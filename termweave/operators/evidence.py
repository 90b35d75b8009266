"""What records say explicitly, as statements that the evidence graph is made of.

Records are (record_id, line, payload as JSON text). A small table of steps, (state, key) to state, describes where in a
record something is said: which objects speak for an entity (assemblies, samples, projects, sequencing experiments, the
record itself), and which of their fields name another. One pass over the payloads walks them along that table and gives
rows (record, object, field, item, code, text) that know their places in the payload. Where they are walked, choices are made
between fields of which the first that is there counts, and the parts of an item are put together. An object is one row,
within which its own accession is found, so nothing is shuffled; then a broadcast join with the codes says what is read at
each of its fields. Records are read one by one, also if they share an id. A statement is one row:

    record_id, line, source_type, source_id, source_label, relation, target_type, target_id, target_label, path, value, status

and a statement without a relation only mentions its source. Nothing is read from free text, and nothing below the root
of a record is taken to speak for its root. ``path`` is the place of the field that was really read, with the places of
items for lists of objects, publications, attributes and archive ids.

Lists are read up to ``MOST`` items (diseases up to ``MOST_DISEASES``); ``accounting`` counts the records that had more,
and those that said nothing. Null and malformed payloads and fields give no statements.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termweave.functions.text import identifiers, meaningful, publication_ids, repository
from termweave.plans.session import checkpoints

MOST, MOST_DISEASES, LONGEST = 100, 50, 300
STATEMENT = ["record_id", "line", "source_type", "source_id", "source_label", "relation", "target_type", "target_id", "target_label", "path", "value", "status"]
# What a piece of evidence rests on.
EXPLICIT, DERIVED = "explicit field", "repository derived from identifier namespace"

# The keys of a record that hold objects of a role, and the type of entity that a role speaks for.
PLACES = {"assembly": ["genome", "genomes", "bvbrc"], "sample": ["biosample", "biosamples"], "study": ["bioproject", "bioprojects"], "experiment": ["sra_experiments", "sra-experiment", "sra_runs"]}
SPEAKS_FOR = {"assembly": "sequence", "sample": "sample", "study": "study", "experiment": "sequence"}
# By role, (field, use, type, relation, choice, rank): of the fields of one choice that of the least rank
# that is there counts. ``raw`` relations carry the field's text as their value, others the identifier.
FIELDS = {
    "assembly": [
        ("accession", "own", "sequence", None, "own", 0),
        ("currentAccession", "own", "sequence", None, "own", 1),
        ("assembly_accession", "own", "sequence", None, "own", 2),
        ("biosample_accession", "refs", "sample", "sequenced from", None, 0),
        ("assemblyInfo/biosample/accession", "inner", "sample", "sequenced from", "inner", 0),
        ("assemblyInfo/biosample/_key", "inner", "sample", "sequenced from", "inner", 1),
        ("assemblyInfo/biosample/record_id", "inner", "sample", "sequenced from", "inner", 2),
        ("bioproject_accession", "raw", "study", "belongs to study", None, 0),
        ("assemblyInfo/bioprojectAccession", "raw", "study", "belongs to study", None, 0),
        ("pairedAccession", "raw", "sequence", "paired assembly", "paired", 0),
        ("assemblyInfo/pairedAssembly/accession", "raw", "sequence", "paired assembly", "paired", 1),
        ("genbank_accessions", "refs", "sequence", "linked sequence", None, 0),
        ("refseq_accessions", "refs", "sequence", "linked sequence", None, 0),
        ("sra_accession", "refs", "sequence", "linked sequence", None, 0),
        ("organism/taxId", "taxon", "organism", "organism", "taxon", 0),
        ("taxon_id", "taxon", "organism", "organism", "taxon", 1),
        ("organism/organismName", "called", "organism", "organism", "called", 2),
        ("organism_name", "called", "organism", "organism", "called", 3),
        ("species", "called", "organism", "organism", "called", 4),
        ("disease", "disease", "disease", "reported disease", None, 0),
        ("host_disease", "disease", "disease", "reported disease", None, 0),
        ("publication", "cites", "publication", "cites", "cites", 0),
        ("publications", "cites", "publication", "cites", "cites", 1),
        ("niaid_program", "program", "program", "reported NIAID program", "program", 0),
        ("niaid_programs", "program", "program", "reported NIAID program", "program", 1),
        ("genome_id", "supplied", "repository", "metadata supplied by", "supplied", 0),
        ("bvbrc_id", "supplied", "repository", "metadata supplied by", "supplied", 1),
    ],
    "sample": [
        ("accession", "own", "sample", None, "own", 0),
        ("_key", "own", "sample", None, "own", 1),
        ("record_id", "own", "sample", None, "own", 2),
        ("title", "title", None, None, None, 0),
        ("taxon_id", "taxon", "organism", "organism", "taxon", 0),
        ("description/organism/taxId", "taxon", "organism", "organism", "taxon", 1),
        ("taxonomy_name", "called", "organism", "organism", "called", 2),
        ("description/organism/organismName", "called", "organism", "organism", "called", 3),
        ("bioprojects", "refs", "study", "belongs to study", "project", 0),
        ("bioproject_accession", "refs", "study", "belongs to study", "project", 1),
        ("sra_sample", "refs", "sample", "same sample identifier", None, 0),
        ("id_recs", "archive", "sample", "same sample identifier", None, 0),
        ("disease", "disease", "disease", "reported disease", None, 0),
        ("hostDisease", "disease", "disease", "reported disease", None, 0),
        ("host_disease", "disease", "disease", "reported disease", None, 0),
        ("attributes", "attribute", "disease", "reported disease", None, 0),
        ("attribute_recs", "attribute", "disease", "reported disease", None, 0),
        ("niaid_program", "program", "program", "reported NIAID program", "program", 0),
        ("niaid_programs", "program", "program", "reported NIAID program", "program", 1),
    ],
    "study": [
        ("accession", "own", "study", None, "own", 0),
        ("_key", "own", "study", None, "own", 1),
        ("title", "title", None, None, None, 0),
        ("publications", "cites", "publication", "cites", None, 0),
        ("niaid_program", "program", "program", "reported NIAID program", "program", 0),
        ("niaid_programs", "program", "program", "reported NIAID program", "program", 1),
    ],
    "experiment": [
        ("accession", "own", "sequence", None, "own", 0),
        ("run_accession", "own", "sequence", None, "own", 1),
        ("experiment_accession", "own", "sequence", None, "own", 2),
        ("title", "title", None, None, None, 0),
        ("sample_accession", "raw", "sample", "sequenced from", None, 0),
        ("study_accession", "raw", "study", "belongs to study", None, 0),
        ("experiment_accession", "raw", "sequence", "run of experiment", None, 0),
    ],
    "root": [
        ("extras/taxonomy_id", "taxon", "organism", "organism", "taxon", 0),
        ("extras/organism", "called", "organism", "organism", "called", 1),
        ("disease", "disease", "disease", "reported disease", None, 0),
        ("extras/attributes/host_disease", "disease", "disease", "reported disease", "ill", 0),
        ("extras/attributes/disease", "disease", "disease", "reported disease", "ill", 1),
        ("niaid_program", "program", "program", "reported NIAID program", "program", 0),
        ("niaid_programs", "program", "program", "reported NIAID program", "program", 1),
    ],
}
ALONE = ("taxon", "called", "title", "supplied")  # uses that read no lists
#: The parts of an item that a use reads; uses that are not here read texts alone.
PARTS = {use: ["accession", "_key", "id"] for use in ("own", "inner", "refs", "raw")} | {"program": ["name"], "cites": ["pmid", "doi", "db", "id", "title"], "archive": ["db", "id"], "attribute": ["harmonized_name", "attribute_name", "name", "value"]}
ITEM, SIZE = "*", "#"  # steps to a list's items, and to the size of a list or object
CODES = "code int, use string, type string, relation string, choice string, rank int, part string"
OBJECTS = "role string, base string, rows array<struct<field string, item string, n int, code int, text string, label string, db string, pmid string, doi string, id string, title string, attribute string>>"
FOUND = "role string, base string, field string, item string, n int, code int, text string, there boolean, size int, label string"


class Step(NamedTuple):
    """Where a key leads: the next state, the role that is entered there if any, whether a field or an item begins, and the
    code of what is read there (-1: nothing)."""

    state: str
    role: str | None
    is_field: bool
    is_item: bool
    code: int


@cache
def steps() -> tuple[dict[str, dict[str, list[Step]]], list[tuple]]:
    """The table of steps, as state -> key -> steps, and the rows of ``CODES``."""
    table: dict[str, dict[str, list[Step]]] = {}
    codes: dict[tuple, int] = {}

    def step(state: str, key: str, target: str, told: tuple | None = None, part: str = "", role: str | None = None, is_field: bool = False, is_item: bool = False) -> str:
        code = codes.setdefault((*told, part), len(codes)) if told else -1
        table.setdefault(state, {}).setdefault(key, []).append(Step(target, role, is_field, is_item, code))
        return target

    for role, fields in FIELDS.items():
        above = {}
        for path, use, kind, relation, choice, rank in fields:
            told = (use, kind, relation, choice or path, rank)
            *names, last = path.split("/")
            state = role
            for name in names:
                if (state, name) not in above:
                    above[state, name] = step(state, name, f"{state}/{name}")
                state = above[state, name]
            field = step(state, last, f"{state}/{last}:{use}", told, is_field=True, is_item=True)
            step(field, SIZE, "", told, SIZE)
            holders = [field] if use in ALONE else [field, step(field, ITEM, f"{field}{ITEM}", told, is_item=True)]
            for holder in holders:
                for part in PARTS.get(use, []):
                    inner = step(holder, part, f"{holder}.{part}", told, part)
                    if (use, part) in (("attribute", "value"), ("archive", "id")):  # these may be lists themselves
                        step(inner, ITEM, f"{inner}{ITEM}", told, part)
    for role, names in PLACES.items():
        for name in names:
            step("top", name, f"{role}@", role=role)
        table[f"{role}@"] = dict(table[role])
        step(f"{role}@", ITEM, role, role=role)
        step(f"{role}@", SIZE, "", ("objects", None, None, role, 0), SIZE)
    step("assembly/assemblyInfo", "biosample", "sample", role="sample")
    table["flat"] = {f"genome.{key}": found for key, found in table["assembly"].items()}
    for use in ("root", "proposed"):  # the last two codes
        codes[(use, "disease" if use == "proposed" else None, "proposed disease" if use == "proposed" else None, use, 0, "")] = len(codes)
    return table, [(i, *told) for told, i in codes.items()]


def text_of(v) -> str:
    """The trimmed text of a text or number; booleans, lists and objects have none."""
    if isinstance(v, str):
        v = v.strip()
        return v if v.isascii() else v.encode("utf-8", "replace").decode()
    return str(v) if isinstance(v, int | float) and not isinstance(v, bool) else ""


def walk(out: list[tuple], table: dict[str, dict[str, list[Step]]], state: str, role: str | None, base: str, place: str, field: str, item: str, n: int, read: int, v) -> None:
    """Adds the rows of ``FOUND`` below a value to out."""
    if not isinstance(v, dict | list):
        if read >= 0 and (text := text_of(v)):
            out.append((role, base, field, item, n, read, text, bool(v), None, None))
        return
    known = table.get(state)
    if not known:
        return
    for s in known.get(SIZE, ()):
        out.append((role, base, field or place, item, n, s.code, None, bool(v), len(v), None))
    if isinstance(v, dict):
        for key in known.keys() & v.keys():
            there, x = f"{place}/{key}", v[key]
            for s in known[key]:
                walk(out, table, s.state, s.role or role, there if s.role else base, there, there if s.is_field else field, there if s.is_item else item, n, s.code, x)
    elif ITEM in known:
        for i, x in enumerate(v[: MOST_DISEASES if state.endswith(":disease") else MOST]):
            there = f"{place}/{i}"
            for s in known[ITEM]:
                walk(out, table, s.state, s.role or role, there if s.role else base, there, field, there if s.is_item else item, i if s.is_item else n, s.code, x)


def found(payload: str | None) -> list[tuple]:
    """The rows of ``FOUND`` of one payload, walked along the steps."""
    try:
        whole = json.loads(payload or "null")
    except (ValueError, RecursionError):
        return []
    if not isinstance(whole, dict):
        return []
    out, (table, codes) = [], steps()
    start = lambda state, role, base, place, v: walk(out, table, state, role, base, place, "", "", 0, -1, v)
    proposal = whole.get("proposal") if isinstance(whole.get("proposal"), dict) else whole if "terms" in whole else None
    record, prefix = (whole["source_record"], "/source_record") if isinstance(whole.get("source_record"), dict) else (whole, "")
    start("top", None, prefix, prefix, record)
    start("flat", "assembly", prefix + "/genome.", prefix, record)
    if record.get("assembly_accession"):
        start("assembly", "assembly", prefix, prefix, record)
    original, below = (record["original_metadata"], prefix + "/original_metadata") if isinstance(record.get("original_metadata"), dict) else (record, prefix)
    rid = record.get("record_id") or original.get("record_id")
    if text_of(rid):
        as_root, as_proposed = len(codes) - 2, len(codes) - 1
        own = (prefix if record.get("record_id") else below) + "/record_id"
        out.append(("root", below, own, own, 0, as_root, text_of(rid), True, None, None))
        start("root", "root", below, below, original)
        if proposal and proposal.get("record_id") == rid:
            terms, known = (x if isinstance(x, list) else [] for x in (proposal.get("terms"), proposal.get("candidate_curies")))
            out.append(("root", below, "", "", 0, as_proposed, None, bool(terms), len(terms), None))
            for i, t in enumerate(terms[:MOST]):
                if isinstance(t, dict) and t.get("ontology") == "MONDO" and t.get("term_id") in known:
                    place = f"{'' if proposal is record else '/proposal'}/terms/{i}"
                    out.append(("root", below, place, place, i, as_proposed, text_of(t["term_id"]), True, None, text_of(t.get("label") or t["term_id"])))
    return out


def walked(records: DataFrame) -> DataFrame:
    """The rows of what records say, by the steps, with what their codes stand for."""
    fields = [f for f in records.schema if f.name in ("record_id", "line")]
    shape = StructType([*fields, *StructType.fromDDL(FOUND)])
    arrow = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for i, payload in enumerate(batch.column(2).to_pylist()):
                mine = found(payload)
                rows += mine
                of += [i] * len(mine)
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], shape.names)

    codes = records.sparkSession.createDataFrame(steps()[1], CODES)
    rows = records.select("record_id", "line", F.col("payload").cast("string")).mapInArrow(run, StructType([records.schema["record_id"], records.schema["line"], *StructType.fromDDL(FOUND)]))
    return rows.join(F.broadcast(codes), "code").drop("code")


def _names(text: Column, kind: Column) -> Column:
    """The identifiers in a text of the type that a column names."""
    out = F.when(kind == "study", identifiers(text, "study")).when(kind == "sample", identifiers(text, "sample")).when(kind == "sequence", identifiers(text, "sequence"))
    return F.coalesce(out, F.array().cast("array<string>"))


def gathered(rows: list[tuple]) -> dict[tuple[str, str], list[tuple]]:
    """The rows that count of one payload's rows of ``FOUND``, as (role, base) -> rows of ``OBJECTS``: of a choice the fields of
    the least rank that is there, of an item's ways to name an identifier the first, with what an item's parts say together."""
    codes = steps()[1]
    best: dict[tuple, int] = {}
    for role, base, _, _, _, code, _, there, _, _ in rows:
        _, _, _, _, choice, rank, _ = codes[code]
        if there and rank < best.get((role, base, choice), rank + 1):
            best[role, base, choice] = rank
    kept, items = [], {}
    for row in rows:
        role, base, _, item, _, code, text, _, _, _ = row
        _, use, _, _, choice, rank, part = codes[code]
        if text is not None and rank == best.get((role, base, choice)):
            parts = items.setdefault((role, base, choice, item), {})
            parts[part] = max(text, parts.get(part, text))
            kept.append((row, use, part, parts))
    out: dict[tuple[str, str], list[tuple]] = {}
    turn = {part: i for i, part in enumerate(PARTS["refs"], 1)}
    for (role, base, field, item, n, code, text, _, _, label), use, part, parts in kept:
        together = (None,) * 6
        if use in ("own", "inner", "refs", "raw"):
            if turn.get(part, 0) > min(turn.get(x, 0) for x in parts):
                continue
        elif use in ("cites", "archive", "attribute"):
            together = (*map(parts.get, ("db", "pmid", "doi", "id", "title")), parts.get("harmonized_name") or parts.get("attribute_name") or parts.get("name"))
        out.setdefault((role, base), []).append((field, item, n, code, text, label, *together))
    return out


def objects(records: DataFrame) -> DataFrame:
    """A row of ``OBJECTS`` for each object of a record that says something."""
    strings, of_row = pa.string(), {"n": pa.int32(), "code": pa.int32()}
    fields = [f.name for f in StructType.fromDDL(OBJECTS)["rows"].dataType.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys, ends, rows = [], [], [0], []
            for i, payload in enumerate(batch.column(2).to_pylist()):
                for key, own in gathered(found(payload)).items():
                    of.append(i)
                    keys.append(key)
                    rows += own
                    ends.append(len(rows))
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            packed = pa.StructArray.from_arrays([pa.array(c, of_row.get(f, strings)) for c, f in zip(columns, fields, strict=True)], fields)
            at = pa.array(of, pa.int64())
            role, base = (pa.array([k[j] for k in keys], strings) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), role, base, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), packed)], ["record_id", "line", "role", "base", "rows"])

    shape = StructType([records.schema["record_id"], records.schema["line"], *StructType.fromDDL(OBJECTS)])
    return records.select("record_id", "line", F.col("payload").cast("string")).mapInArrow(run, shape)


def statements(records: DataFrame, kept: bool = True) -> DataFrame:
    """All statements of the records; they are checkpointed, so that payloads are parsed once, unless they are not kept."""
    made = stated(objects(records))
    if not kept:
        return made
    checkpoints(records.sparkSession)
    return made.checkpoint()


def stated(objects: DataFrame) -> DataFrame:
    """The statements of objects. What the fields of an object say together is found within its row, so nothing is shuffled."""
    spark, codes = objects.sparkSession, steps()[1]
    role, told_of = F.col("role"), lambda r: meaningful(F.coalesce(r["label"], r["text"]))
    picked = lambda uses, f: F.transform(F.filter("rows", lambda r: r["code"].isin([c[0] for c in codes if c[1] in uses])), f)
    first = lambda kind: lambda r: F.struct(r["n"].alias("n"), F.get(_names(r["text"], kind), F.lit(0)).alias("x"))
    least = lambda pairs: F.array_min(F.filter(pairs, lambda p: p["x"].isNotNull()))
    root_kind = lambda text: F.when(F.size(identifiers(text, "sample")) > 0, "sample").otherwise("sequence")
    ranks = F.array(*(F.lit(c[5]) for c in codes))
    inner = least(picked(("inner",), first(F.lit("sample"))))
    root = F.array_max(picked(("root",), lambda r: F.struct(root_kind(r["text"]).alias("type"), F.get(_names(r["text"], root_kind(r["text"])), F.lit(0)).alias("x"))))
    together = {
        "own_id": least(picked(("own",), first(F.when(role.isin("study", "sample"), role).otherwise("sequence"))))["x"],
        "inner_n": inner["n"],
        "inner_id": inner["x"],
        "root_type": root["type"],
        "root_id": root["x"],
        "own_title": F.array_max(picked(("title",), told_of)),
        "taxon": F.array_max(picked(("taxon",), lambda r: r["text"])),
        "name": F.array_max(picked(("called",), told_of)),
        "supplied": F.array_max(picked(("supplied",), lambda r: r["text"])),
        "seen": F.array_min(picked(("taxon", "called"), lambda r: F.get(ranks, r["code"]))),
    }
    named = objects.select("*", *(c.alias(k) for k, c in together.items())).select("record_id", "line", "role", "base", *together, F.inline("rows"))
    named = named.join(F.broadcast(spark.createDataFrame(codes, CODES)), "code").drop("code")
    named = named.withColumns({"db": F.lower("db"), "attribute": F.replace(F.lower("attribute"), F.lit(" "), F.lit("_")), "type": F.coalesce(F.when(F.col("use") == "root", root_kind(F.col("text"))), "type")})
    named = named.withColumns({"names": F.when(F.col("use").isin("own", "inner", "refs", "raw", "archive", "root"), _names(F.col("text"), F.col("type"))), "told": meaningful(F.coalesce("label", "text"))})
    cited = F.expr("case when use = 'cites' then case when part = '' then text when pmid is not null then concat('PMID:', pmid) when doi is not null then concat('DOI:', doi) when db in ('pubmed', 'pmid') then concat('PMID:', id) when db = 'doi' then concat('DOI:', id) end end")
    named = named.withColumns({"first_name": F.get("names", F.lit(0)), "cited": cited}).withColumns({"publications": publication_ids(F.col("cited")), "entry": meaningful(F.when(F.col("part") != "", F.col("title")))})
    kinds = ", ".join(f"'{role}', '{kind}'" for role, kind in SPEAKS_FOR.items())
    one = lambda i, label, path, value, source="null": f"named_struct('id', cast({i} as string), 'label', cast({label} as string), 'path', cast({path} as string), 'value', cast({value} as string), 'source', cast({source} as string))"
    disease = lambda path: f"array({one("concat('reported:', lower(told))", 'told', path, 'told')})"
    targets = f"""case
      when use = 'refs' then transform(names, t -> {one('t', 'null', 'field', 't')})
      when use = 'raw' then transform(names, t -> {one('t', 'null', 'field', "case when item = field and part = '' then text else '' end")})
      when use = 'archive' and db = 'sra' and part = 'id' then transform(names, t -> {one('t', 'null', "concat(item, '/id')", 't')})
      when use = 'own' and role = 'assembly' and endswith(base, '/bvbrc') and first_name = own_id then array({one("'BV-BRC'", 'null', 'base', "coalesce(supplied, '')")})
      when use = 'inner' and n = inner_n and first_name = inner_id then array({one('inner_id', 'null', "concat(base, case when endswith(base, 'genome.') then '' else '/' end, 'assemblyInfo/biosample/accession')", 'inner_id')})
      when use in ('taxon', 'called') and rank = seen then array({one("case when taxon rlike '^0*[1-9][0-9]*$' then concat('NCBITaxon:', taxon) else concat('name:', lower(name)) end", "coalesce(name, concat('Taxon ', taxon))", "case when role = 'root' then concat(base, '/extras') else field end", 'coalesce(taxon, name)')})
      when use = 'cites' and part = case when part = '' then '' when pmid is not null then 'pmid' when doi is not null then 'doi' else 'id' end then transform(publications, t -> {one('t', 'entry', 'item', 't')})
      when use = 'program' then array({one("concat('NIAID:', lower(told))", 'told', 'field', 'told')})
      when char_length(told) > {LONGEST} then null
      when use = 'disease' then {disease('field')}
      when use = 'attribute' and part = 'value' and attribute in ('disease', 'host_disease') then {disease("concat(item, '/value')")}
      when use = 'proposed' and text rlike '^MONDO:[0-9]+$' then array({one('text', 'told', 'field', 'text')})
    end"""
    # an object's own accession is mentioned even where nothing is said of another; an assembly mentions all it lists
    mentioned = "case when use = 'root' then array(root_id) when use = 'own' and role = 'assembly' then names when use = 'own' then filter(names, t -> t = own_id) end"
    return spark.sql(
        f"""with owned as (
  select *, case when role = 'root' then root_type else map({kinds})[role] end as source_type, case when role = 'root' then root_id else own_id end as source_id, case when role <> 'root' then own_title end as source_label
  from {{named}}
), said as (
  select record_id, line, source_type, source_id, source_label, coalesce(relation, 'metadata supplied by') as relation, case when relation is null then 'repository' else type end as target_type,
    inline(concat(coalesce({targets}, array()), coalesce(transform({mentioned}, x -> {one('null', 'null', 'field', 'x', 'x')}), array())))
  from owned where source_id is not null
)
select record_id, line, source_type, coalesce(source, source_id) as source_id, case when source is null or source = source_id then source_label end as source_label,
  case when source is null then relation end as relation, case when source is null then target_type end as target_type, id as target_id, label as target_label, path,
  substring(coalesce(value, ''), 1, {LONGEST}) as value, case when relation = 'proposed disease' then 'proposed' else 'reported' end as status
from said where source is not null or id is not null""",
        named=named,
    )


def facts(records: DataFrame) -> DataFrame:
    """The statements of the records with nulls for what tells of records, labels and places: what the keys of nodes and
    edges can be read from. They are written as a table to the checkpoint folder, so that payloads are parsed once."""
    spark, said = records.sparkSession, statements(records, kept=False)
    own = said.select("source_type", "source_id", "relation", "target_type", "target_id", "status")
    path = f"{checkpoints(spark)}/facts-{uuid.uuid4().hex}"
    own.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(own.schema).parquet(path)
    return table.select(*(F.col(f.name) if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in said.schema))


def mentions(said: DataFrame) -> DataFrame:
    """(type, identifier, label, record_id) of every entity in the statements, and of the repositories they lie in."""
    end = lambda side: F.struct(F.col(f"{side}_type").alias("type"), F.col(f"{side}_id").alias("identifier"), F.col(f"{side}_label").alias("label"))
    both = said.select("record_id", F.explode(F.array(end("source"), end("target"))).alias("x")).select("x.*", "record_id").where("identifier is not null")
    lies = F.struct(F.lit("repository").alias("type"), repository(F.col("identifier"), F.col("type")).alias("identifier"), F.lit(None).cast("string").alias("label"))
    return both.select("record_id", F.explode(F.array(F.struct("type", "identifier", "label"), lies)).alias("x")).select("x.*", "record_id").where("identifier is not null")


def claims(said: DataFrame) -> DataFrame:
    """(source, target, relation, status, evidence) for ``graph.edges``; evidence: record, line, path, value and basis."""
    key = lambda side: F.concat_ws(":", f"{side}_type", f"{side}_id")
    evidence = lambda value, basis: F.struct("record_id", "line", "path", value.alias("value"), F.lit(basis).alias("basis"))
    one = lambda source, target, relation, status, told: F.struct(source.alias("source"), target.alias("target"), relation.alias("relation"), status.alias("status"), told.alias("evidence"))

    def lies(side: str) -> Column:
        archive = repository(F.col(f"{side}_id"), F.col(f"{side}_type"))
        return one(key(side), F.concat(F.lit("repository:"), archive), F.lit("registered in"), F.lit("derived"), evidence(F.col(f"{side}_id"), DERIVED))

    # what a source's own accession says is said where it is mentioned, a target's where it is named
    own = F.when(F.col("relation").isNotNull(), one(key("source"), key("target"), F.col("relation"), F.col("status"), evidence(F.col("value"), EXPLICIT)))
    source = F.when(F.col("relation").isNull(), lies("source"))
    target = F.when(F.col("target_id").isNotNull(), lies("target"))
    return said.select(F.explode(F.array(own, source, target)).alias("x")).select("x.*").where("target is not null")


def accounting(records: DataFrame, said: DataFrame) -> DataFrame:
    """One row: records, unsupported (those that say nothing), truncated (those with a list that was cut, or a disease
    that is too long)."""
    most = F.when(F.col("use") == "disease", MOST_DISEASES).otherwise(MOST)
    long = F.col("use").isin("disease", "attribute", "proposed") & (F.char_length(F.coalesce("label", "text")) > LONGEST)
    cut = walked(records).where((F.col("size") > most) | long).select("record_id").distinct().withColumn("cut", F.lit(1))
    there = said.select("record_id").distinct().withColumn("there", F.lit(1))
    counts = records.select("record_id").join(there, "record_id", "left").join(cut, "record_id", "left")
    return counts.agg(F.count("*").alias("records"), F.count_if(F.col("there").isNull()).alias("unsupported"), F.count_if(F.col("cut").isNotNull()).alias("truncated"))
