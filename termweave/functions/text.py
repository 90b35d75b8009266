"""Scalar rules for identifiers and free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing value in sample metadata, case-folded.
MISSING = ["", "-", "na", "n/a", "none", "null", "unknown", "missing", "not provided", "not applicable", "not collected", "not available", "unspecified"]
# Fixed patterns of identifiers.
STUDY = r"(?:PRJ[NED][AB]\d+|[SED]RP\d+)"
SAMPLE = r"(?:SAM[NED][A-Z]?\d+|[SED]RS\d+)"
SEQUENCE = r"(?:GC[AF]_\d+(?:\.\d+)?|[SED]R[RX]\d+|[A-Z]{1,4}(?:_[A-Z]{0,4})?\d{5,}(?:\.\d+)?)"
ASSEMBLY = r"^(GC[AF])_(\d+)\.(\d+)$"


def meaningful(c: Column) -> Column:
    """The trimmed text, or null where it only says that a value is missing."""
    t = F.trim(c)
    return F.when(F.lower(t).isin(MISSING), None).otherwise(t)


def first_text(*columns: Column) -> Column:
    """The first column whose trimmed text is not empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def joined_text(values: Column) -> Column:
    """A list of texts joined by '; ' without empty ones; null if none is left."""
    return F.nullif(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), "; "), F.lit(""))


def curie_prefix(c: Column) -> Column:
    """What stands before the first colon, UNKNOWN without one."""
    return F.when(F.contains(c, F.lit(":")), F.split_part(c, F.lit(":"), F.lit(1))).otherwise(F.lit("UNKNOWN"))


def iri_to_curie(c: Column) -> Column:
    """The last path segment with its first underscore as a colon."""
    return F.regexp_replace(F.substring_index(F.trim(c), "/", -1), "^([^_]*)_", "$1:")


def wgs_accession(url: Column) -> Column:
    """The accession behind /nuccore/ without its version; null without one."""
    return F.nullif(F.regexp_extract(url, "/nuccore/([^.?]+)", 1), F.lit(""))


def assembly_parts(c: Column) -> Column:
    """struct(db, number, version) of a whole assembly accession, else null."""
    part = lambda i: F.regexp_extract(c, ASSEMBLY, i)
    return F.when(F.rlike(c, F.lit(ASSEMBLY)), F.struct(part(1).alias("db"), part(2).alias("number"), part(3).cast("int").alias("version")))


def twin(c: Column) -> Column:
    """The accession in the other assembly database."""
    p = assembly_parts(c)
    return F.concat(F.when(p["db"] == "GCA", "GCF").otherwise("GCA"), F.lit("_"), p["number"], F.lit("."), p["version"].cast("string"))


def identifiers(c: Column, kind: str, most: int = 100) -> Column:
    """The distinct identifiers of a kind (study, sample, sequence) in a text, in order; sequences are neither of the others."""
    whole = lambda x, p: F.rlike(x, F.lit(f"^(?:{p})$"))
    if kind == "sequence":
        keep = lambda x: whole(x, SEQUENCE) & ~whole(x, STUDY) & ~whole(x, SAMPLE)
    else:
        keep = lambda x: whole(x, {"study": STUDY, "sample": SAMPLE}[kind])
    return F.slice(F.array_distinct(F.filter(F.split(c, r"[,;|\s]+"), keep)), 1, most)


def publication(c: Column) -> Column:
    """'PMID:n' or 'DOI:x' of a text that is one publication's name, with its case folded so that names can be compared,
    else null; ``publication_ids`` reads lists and keeps the case."""
    pmid = F.regexp_extract(c, r"(?i)^\s*(?:pmid:?\s*|https?://(?:www\.)?(?:ncbi\.nlm\.nih\.gov/pubmed|pubmed\.ncbi\.nlm\.nih\.gov)/)?(\d{1,9})/?\s*$", 1)
    doi = F.regexp_extract(c, r"(?i)^\s*(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/\S+?)\s*$", 1)
    return F.when(pmid != "", F.concat(F.lit("PMID:"), pmid)).when(doi != "", F.concat(F.lit("DOI:"), F.lower(doi)))


def publication_ids(c: Column) -> Column:
    """The distinct 'PMID:n' and 'DOI:x' that the parts of a text name, in order; a DOI keeps its case."""
    pmid = lambda x: F.regexp_extract(x, r"(?i)^(?:PMID:|https://pubmed\.ncbi\.nlm\.nih\.gov/)?(\d+)/?$", 1)
    doi = lambda x: F.regexp_extract(x, r"(?i)^(?:DOI:|https://doi\.org/)?(10\.\d{4,9}/\S+)$", 1)
    one = lambda x: F.when(pmid(x) != "", F.concat(F.lit("PMID:"), pmid(x))).when(doi(x) != "", F.concat(F.lit("DOI:"), doi(x)))
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[,;\s]+"), one), lambda x: x.isNotNull()))


def confidence(c: Column) -> Column:
    """low, medium or high of a label or number; what cannot be read is medium."""
    t = F.lower(F.trim(c))
    n = t.try_cast("double")
    return F.when(t.isin("low", "medium", "high"), t).when(t.isin("med", "mid"), "medium").when(n >= 0.7, "high").when(n >= 0.4, "medium").when(n.isNotNull(), "low").otherwise("medium")


def confidence_of_score(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def three_decimals(x: Column) -> Column:
    """A number as text with three decimals, rounded from its exact binary value as C and Python do: ``format_string`` rounds
    its shortest decimal text half up instead. Java's decimal format is exact too, but gives zero for 0.0005 alone."""
    least = F.when(x > 0, "0.001").otherwise("-0.001")
    return F.when(F.abs(x) == 0.0005, least).otherwise(F.call_function("format_number", x, F.lit("0.000")))


def pointer_escape(key: Column) -> Column:
    """A key as a segment of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def description(name: Column, definition: Column) -> Column:
    """The text that is embedded for a term: its name, and its definition if it has one."""
    return F.lower(F.trim(F.concat_ws(": ", name, F.nullif(definition, F.lit("")))))


def fingerprint(json_text: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys, so that the order of keys does not matter."""
    return F.sha2(F.to_json(F.try_parse_json(json_text)), 256)


# The archive of an identifier by its form, and where it is shown there.
ARCHIVES = [
    (r"^PRJ", "BioProject", "https://www.ncbi.nlm.nih.gov/bioproject/"),
    (r"^SAM", "BioSample", "https://www.ncbi.nlm.nih.gov/biosample/"),
    (r"^[SED]R[PSRX]\d+$", "SRA / INSDC", "https://www.ncbi.nlm.nih.gov/sra/?term="),
    (r"^GC[AF]_", "NCBI Assembly", "https://www.ncbi.nlm.nih.gov/datasets/genome/"),
    (r"^PMID:", "PubMed", "https://pubmed.ncbi.nlm.nih.gov/"),
    (r"^DOI:", "DOI", "https://doi.org/"),
    (r"^NCBITaxon:", "NCBI Taxonomy", "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id="),
]
NUCLEOTIDE = ("GenBank / RefSeq", "https://www.ncbi.nlm.nih.gov/nuccore/")


def repository(identifier: Column, kind: Column) -> Column:
    """The archive that an identifier lies in, by its form; other sequences lie in the nucleotide archive."""
    first, *rest = ARCHIVES
    out = F.when(F.rlike(identifier, F.lit(first[0])), first[1])
    for pattern, name, _ in rest[:3]:
        out = out.when(F.rlike(identifier, F.lit(pattern)), name)
    out = out.when(kind == "sequence", NUCLEOTIDE[0])
    for pattern, name, _ in rest[3:]:
        out = out.when(F.rlike(identifier, F.lit(pattern)), name)
    return out


def repository_url(identifier: Column, kind: Column) -> Column:
    """The page of an identifier in its archive, null without one."""
    name, bare = repository(identifier, kind), F.regexp_replace(identifier, "^(PMID|DOI|NCBITaxon):", "")
    path = F.when(name == "DOI", F.replace(F.url_encode(bare), F.lit("%2F"), F.lit("/"))).otherwise(bare)
    page = F.when(name == NUCLEOTIDE[0], NUCLEOTIDE[1])
    for _, archive, url in ARCHIVES:
        page = page.when(name == archive, url)
    return F.concat(page, path, F.when(name.isin("PubMed", "NCBI Assembly"), "/").otherwise(""))
