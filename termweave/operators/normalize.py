"""From combined records (genome, annotation, samples, projects as nested columns) to flat ones, by ordered choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

# Where each field is looked for, in order; a: an attribute of the first sample, s: the first sample,
# b: the annotation, g: the genome, p: the first project.
ORDER = {
    "record_id": ["g.currentAccession", "g.accession", "s.accession", "b.genome_id"],
    "isolation_source": ["b.isolation_source", "a.isolation_source", "s.isolationSource"],
    "body_sample_site": ["b.body_sample_site", "a.body_sample_site"],
    "tissue": ["a.tissue", "a.tissue_type"],
    "host": ["a.host", "b.host_name", "s.host"],
    "disease": ["a.host_disease", "b.disease", "a.disease"],
    "note": ["a.note", "a.description", "a.sample_type"],
    "environment": ["a.env_medium", "a.env_broad_scale", "a.env_local_scale", "a.environment"],
    "geo_loc_name": ["a.geo_loc_name", "b.geographic_location", "s.geoLocName"],
    "collection_date": ["a.collection_date", "b.collection_date", "s.collectionDate"],
    "strain": ["a.strain", "b.strain", "s.strain"],
    "biosample_description": ["s.title", "s.description.title"],
    "bioproject_title": ["p.title"],
}
# The accessions that are kept beside the fields.
EXTRAS = {"biosample_accession": "s.accession", "bioproject_accession": "p.accession", "genome_accession": "g.accession", "bvbrc_genome_id": "b.genome_id"}
# The order in which the selector of records with new values looks for them.
SELECT_ORDER = {
    "isolation_source": ["b.isolation_source", "a.isolation_source", "a.isolation source"],
    "host": ["s.host", "b.host_name", "a.host"],
    "disease": ["b.disease", "a.disease"],
    "body_sample_site": ["b.body_sample_site", "a.body_sample_site", "a.body sample site"],
    "geo_loc_name": ["s.geoLocName", "b.geographic_location", "a.geo_loc_name"],
    "strain": ["s.strain", "b.strain", "a.strain"],
    "tissue": ["a.tissue"],
    "environment": ["a.env_medium", "a.environment"],
    "note": ["a.note"],
    "collection_date": ["s.collectionDate", "b.collection_date", "a.collection_date"],
}
NAMES = ["harmonized_name", "name", "attribute_name"]


def attributes(entries: Column, there: list[str] = NAMES) -> Column:
    """A list of attributes as a map: the name is the first of ``NAMES`` that is there, null values go, the last wins."""
    key = lambda e: F.coalesce(*(e[n] for n in NAMES if n in there))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & key(e).isNotNull())
    names = F.array_distinct(F.transform(kept, key))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(kept, lambda e: key(e) == n), -1)["value"])))


def _there(kind: K.DataType, path: list[str]) -> K.DataType | None:
    for name in path:
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, K.StructType) else None
    return kind


def _text(c: Column, kind: K.DataType) -> Column:
    if isinstance(kind, K.ArrayType):
        c = F.array_join(F.filter(c.cast("array<string>"), lambda v: v.isNotNull() & (v != "")), "; ")
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _finder(records: DataFrame) -> tuple[Callable[[str], Column | None], Column | None]:
    """What gives the text at a path of ``ORDER``, None where the schema does not have it; and the attributes as a map."""
    own = {f.name: f.dataType for f in records.schema}
    first = lambda name: (F.get(name, F.lit(0)), own[name].elementType) if name in own else (None, None)
    sample, project = first("biosamples"), first("bioprojects")
    roots = {"g": (F.col("genome"), own["genome"]) if "genome" in own else (None, None), "b": (F.col("bvbrc"), own["bvbrc"]) if "bvbrc" in own else (None, None), "s": sample, "p": project}
    listed = _there(sample[1], ["attributes"]) if sample[1] is not None else None
    held = attributes(sample[0]["attributes"], listed.elementType.names) if listed is not None else None

    def of(path: str) -> Column | None:
        root, *names = path.split(".")
        if root == "a":
            return F.nullif(F.trim(F.try_element_at(held, F.lit(names[0]))), F.lit("")) if held is not None else None
        c, kind = roots[root]
        leaf = _there(kind, names) if kind is not None else None
        if leaf is None:
            return None
        for n in names:
            c = c[n]
        return _text(c, leaf)

    return of, held


def selected(records: DataFrame, fields: list[str]) -> DataFrame:
    """records with one text column for each of the fields of ``SELECT_ORDER``, empty where nothing is found, for
    ``linkage.unique_by``; a field that is not there raises."""
    unknown = [f for f in fields if f not in SELECT_ORDER]
    if unknown:
        raise ValueError(f"unknown field {', '.join(unknown)}; there are {', '.join(sorted(SELECT_ORDER))}")
    of, _ = _finder(records)
    found = {name: [c for c in map(of, SELECT_ORDER[name]) if c is not None] for name in fields}
    return records.withColumns({name: F.coalesce(*cs, F.lit("")) for name, cs in found.items()})


def flat(records: DataFrame) -> DataFrame:
    """The flat record of each combined one; columns that the input does not have count as null. A record without any
    accession is named by a hash of its content. comments are the annotation's texts, extras the accessions and all
    attributes of the first sample."""
    own = {f.name: f.dataType for f in records.schema}
    of, held = _finder(records)
    out = []
    for name, paths in ORDER.items():
        found = [c for c in map(of, paths) if c is not None]
        if name == "record_id":
            found.append(F.concat(F.lit("unknown_"), F.pmod(F.xxhash64(F.to_json(F.struct(*records.columns))), F.lit(1_000_000)).cast("string")))
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    # what is said in free text, and every attribute of the first sample
    said = _there(own["bvbrc"], ["comments"]) if "bvbrc" in own else None
    texts = F.lit(None).cast("array<string>") if said is None else F.col("bvbrc.comments").cast("array<string>") if isinstance(said, K.ArrayType) else F.when(F.trim(F.col("bvbrc.comments").cast("string")) != "", F.array(F.col("bvbrc.comments").cast("string")))
    attrs = held.cast("map<string,string>") if held is not None else F.lit(None).cast("map<string,string>")

    def leaf(path: str) -> Column:
        found = of(path)
        return found if found is not None else F.lit(None).cast("string")

    extras = F.struct(*(leaf(p).alias(n) for n, p in EXTRAS.items()), attrs.alias("biosample_attrs"))
    return records.select(*out, texts.alias("comments"), extras.alias("extras"))
