"""Column builders for the fields of source records: licences, venues, identities and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text

# Spellings of licences, parts of licence URLs in the order they are tried, and pages of publishers.
LICENSES = {"cc-by": "cc-by", "cc-by-4.0": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc0": "cc0", "cc0-1.0": "cc0"}
LICENSE_URLS = [("licenses/by/", "cc-by"), ("licenses/by-sa/", "cc-by-sa"), ("licenses/by-nc/", "cc-by-nc"), ("licenses/by-nc-sa/", "cc-by-nc-sa"), ("licenses/by-nc-nd/", "cc-by-nc-nd"), ("publicdomain/zero/", "cc0")]
# How sure a kind of licence label is, and the sources' order for licences.
LICENSE_QUALITY = {"publisher-tdm-policy": 30, "publisher-license-page": 20, "publisher-copyright-policy": 10}
LICENSE_SOURCES = {"openalex": 100, "crossref": 90, "semantic_scholar": 70, "arxiv": 60}
# Titles of book series.
SERIES = ["lecture notes in", "springer series", "advances in intelligent systems", "communications in computer and information science"]
# Source families by the names they go by.
FAMILIES = {"arxiv": ["arxiv", "arxiv_kaggle_snapshot"], "acl_anthology": ["acl", "acl_anthology"], "openalex": ["openalex", "openalex_alignment"], "semantic_scholar": ["semantic_scholar", "semantic_scholar_alignment", "s2"], "crossref": ["crossref", "crossref_alignment"], "paperswithcode": ["paperswithcode", "paperswithcode_alignment", "pwc"]}
# What a link to code has in it, and conferences by their names in upper case where they are written otherwise.
CODE_WORDS = ["github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "huggingface.co", "project", "implementation", "source-code", "source_code", "code", "software"]
CONFERENCES = {"NIPS": "NeurIPS", "NEURIPS": "NeurIPS", "THEWEBCONF": "TheWebConf", "INTERSPEECH": "Interspeech"}
CONFERENCE_NAMES = "NIPS NEURIPS ICLR ICML CVPR ICCV ECCV AAAI IJCAI ACL EMNLP NAACL EACL COLING KDD WWW THEWEBCONF SIGIR UAI AISTATS INTERSPEECH ACMMM MM WACV".split()


def _lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def license_label(c: Column) -> Column:
    """A licence's short name; a publisher's policy as such; anything else as written, in lower case with hyphens. Empty: null."""
    t = F.replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), F.lit(" "), F.lit("-"))
    out = F.when(t == "", None).when(_lookup(t, LICENSES).isNotNull(), _lookup(t, LICENSES))
    for part, name in LICENSE_URLS:
        out = out.when(t.contains(f"creativecommons.org/{part}"), name)
    out = out.when(t.contains("elsevier.com/tdm") | t.contains("springer.com/tdm") | t.contains("springernature.com"), "publisher-tdm-policy")
    return out.when(t.contains("ieeexplore.ieee.org") & t.contains("license"), "publisher-license-page").otherwise(t)


def license_rank(label: Column, source: Column) -> Column:
    """What the best of several licences is the largest of: (quality, priority of the source, label); null without a label."""
    quality = F.when(label.startswith("cc-") | (label == "cc0"), 100).otherwise(F.coalesce(_lookup(label, LICENSE_QUALITY), F.lit(0)))
    return F.when(label.isNotNull(), F.struct(quality.alias("quality"), F.coalesce(_lookup(F.coalesce(source, F.lit("")), LICENSE_SOURCES), F.lit(0)).alias("priority"), label.alias("label")))


def is_series(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in SERIES]), lambda x: F.contains(t, x)), F.lit(False))


def venue_fields(kind: Column, venue: Column, journal: Column, conference: Column) -> Column:
    """struct(venue, journal, conference): a chapter's series is neither journal nor conference; a conference's venue names it."""
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    chapter = kind == "book-chapter"
    journal = F.when(~(chapter & is_series(journal)), journal)
    conference = F.when(~(chapter & is_series(conference)), conference)
    empty = F.coalesce(conference, F.lit("")) == ""
    conference = F.when((kind == "conference") & empty & (F.coalesce(venue, F.lit("")) != ""), venue).otherwise(conference)
    return F.struct(venue.alias("venue"), journal.alias("journal"), conference.alias("conference"))


def first_key(normalize, *values: Column) -> Column:
    """The first value that normalizes to something."""
    return F.coalesce(*[normalize(v) for v in values])


def doi_of(doi: Column, *maps: Column) -> Column:
    """DOI key of a record: its own field, then the maps' entries named doi in any case."""
    return first_key(text.doi_key, doi, *[text.map_lookup(m, "doi") for m in maps])


def arxiv_of(arxiv: Column, external: Column, source_ids: Column, source: Column, source_id: Column) -> Column:
    """arXiv id without version: the field, the maps' entries, and for a record of that source its own id."""
    own = F.when(F.lower(source) == "arxiv", source_id)
    return first_key(text.arxiv_key, arxiv, *[text.map_lookup(external, k) for k in ("arxiv_base", "arxiv", "arxiv_id")], *[text.map_lookup(source_ids, k) for k in ("arxiv", "arxiv_id")], own)


def source_name(c: Column) -> Column:
    """A source in lower case with underscores; an alignment is its source. Empty: null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text.normalize_text(c)), r"[\s-]+", "_"), "^_+|_+$", "")
    aliases = {"openalex_alignment": "openalex", "semantic_scholar_alignment": "semantic_scholar", "crossref_alignment": "crossref", "acl": "acl_anthology"}
    return F.nullif(F.coalesce(_lookup(t, aliases), t), F.lit(""))


def provider_identity(source: Column, basis: str, value: Column) -> Column:
    """An identity value in its provider's form; empty: null."""
    t = text.normalize_text(value)
    low = F.lower(t)
    if basis in ("source_record_url", "source_api_url", "canonical_url"):
        return F.when(t != "", text.canonicalize_url(t))
    if basis == "legacy_doc_id":
        return F.nullif(low, F.lit(""))
    ends = lambda c: F.regexp_replace(F.trim(c), "^/+|/+$", "")
    work = F.regexp_extract(F.regexp_replace(t, "/+$", ""), r"(?i)(W\d+)$", 1)
    arxiv = F.regexp_replace(F.regexp_extract(F.regexp_replace(low, r"^(?:https?://(?:export\.)?arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", ""), r"^([^?#]*)", 1), r"\.pdf$", "")
    out = (
        F.when(source == "crossref", ends(F.regexp_replace(low, r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")))
        .when(source == "openalex", F.when(work != "", F.concat(F.lit("https://openalex.org/"), F.upper(work))).otherwise(F.regexp_replace(t, "/+$", "")))
        .when(source == "semantic_scholar", F.regexp_extract(F.regexp_replace(low, "/+$", ""), r"([^/?#]*)$", 1))
        .when(source == "arxiv", ends(arxiv))
        .when(source == "acl_anthology", ends(F.regexp_replace(low, r"^https?://(?:www\.)?aclanthology\.org/", "")))
        .otherwise(t)
    )
    return F.nullif(out, F.lit(""))


BASES = ("source_record_id", "source_id", "source_record_url", "source_api_url", "legacy_doc_id", "canonical_url")


def observation_identity(source: Column, fields: dict[str, Column]) -> Column:
    """struct(source, basis, value, id): the first of BASES that has a value names the record, together with its source."""
    name = source_name(source)
    found = [F.when(v.isNotNull(), F.struct(F.lit(b).alias("basis"), v.alias("value"))) for b in BASES if b in fields for v in (provider_identity(name, b, fields[b]),)]
    first = F.coalesce(*found)
    name_, basis, value = (F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "") for x in (name, first["basis"], first["value"]))
    said = F.concat(F.lit("["), F.concat_ws(",", F.lit('"source_observation_v1"'), name_, basis, value), F.lit("]"))
    return F.when(name.isNotNull() & first.isNotNull(), F.struct(name.alias("source"), first["basis"].alias("basis"), first["value"].alias("value"), text.stable_hash(said).alias("id")))


def source_family(c: Column) -> Column:
    """The family that a source's name belongs to; other names stay. Empty: null."""
    t = F.trim(c)
    return F.nullif(F.coalesce(_lookup(F.lower(t), {n: f for f, names in FAMILIES.items() for n in names}), t), F.lit(""))


def source_families(names: Column, id_keys: Column, tags: Column) -> Column:
    """Sorted families of a record: of its sources, of its ids' names, and of tags that are sources."""
    ids = F.flatten(F.transform(id_keys, lambda k: F.when(F.lower(k).isin("arxiv_id", "arxiv"), F.array(F.lit("arxiv"))).when(F.lower(k).isin("acl_anthology_id", "acl_bibkey"), F.array(F.lit("acl_anthology"))).when(F.lower(k) == "openalex_id", F.array(F.lit("openalex"))).when(F.lower(k) == "semantic_scholar_id", F.array(F.lit("semantic_scholar"))).otherwise(F.array().cast("array<string>"))))
    told = F.filter(F.transform(tags, F.lower), lambda x: x.isin("acl", "acl_anthology", "arxiv"))
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(x, none) for x in (names, ids, told)])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, source_family), lambda x: x.isNotNull())))


def code_links(*texts: Column) -> Column:
    """Distinct URLs that name a host of code or speak of code, in order of the texts."""
    urls = F.concat(*[F.coalesce(text.extract_urls(t), F.array().cast("array<string>")) for t in texts])
    return F.array_distinct(F.filter(urls, lambda u: F.exists(F.array(*[F.lit(h) for h in CODE_WORDS]), lambda h: F.contains(F.lower(u), h))))


def conference_hint(comment: Column) -> Column:
    """The first conference that a comment names."""
    name = F.upper(F.regexp_extract(comment, r"(?i)\b(" + "|".join(sorted(CONFERENCE_NAMES, key=len, reverse=True)) + r")\b", 1))
    return F.nullif(F.coalesce(_lookup(name, CONFERENCES), name), F.lit(""))


def year_of(c: Column) -> Column:
    """A number, or four digits at the start of a text."""
    return F.regexp_extract(F.trim(c.cast("string")), r"^([0-9]{4})", 1).try_cast("int")


def strings_in(json: Column) -> Column:
    """All non-empty strings inside a JSON value, white space as single spaces, in order; numbers, flags and keys are left out."""
    string = r'"(?:[^"\\]|\\.)*"'
    values = F.regexp_replace(json, string + r"\s*:", "")
    found = F.regexp_extract_all(values, F.lit(string), F.lit(0))
    said = F.transform(found, lambda s: text.normalize_text(F.get_json_object(F.concat(F.lit('{"x":'), s, F.lit("}")), "$.x")))
    return F.filter(said, lambda s: s != "")


def embedding_text(title: Column, abstract: Column, lists: dict[str, Column], most: int = 15) -> Column:
    """Title, abstract and a block of named lists; the title alone without an abstract. Concepts and keywords are cut at ``most``."""
    title, abstract = text.normalize_text(title), text.normalize_text(abstract)
    lines = []
    for name, values in lists.items():
        own = F.slice(values, 1, most) if name.lower() in ("concepts", "keywords") else values
        lines.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{name}: "), F.array_join(own, ", "))))
    block = F.nullif(F.concat_ws("\n", *lines), F.lit(""))
    return F.when(abstract == "", title).otherwise(F.concat_ws("\n\n", F.nullif(title, F.lit("")), abstract, block))


def preprint_flag(has_published: Column, any_flag: Column, publication_type: Column) -> Column:
    """Three-valued: no preprint once any source has it published; else what the sources say; else by its type."""
    t = F.lower(F.trim(publication_type))
    by_type = F.when(t.isin("preprint", "working paper"), True).when(t.isin("article", "journal-article", "journal article", "conference", "proceedings", "book-chapter"), False)
    return F.when(has_published, False).otherwise(F.coalesce(any_flag, by_type))


def joined_text(sep: str, *parts: Column) -> Column:
    """The parts that aren't empty, white space as single spaces."""
    return F.concat_ws(sep, *[F.nullif(text.normalize_text(p.cast("string")), F.lit("")) for p in parts])


def compact_json(**parts: Column) -> Column:
    """A JSON object of what isn't null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def phrase_label(phrase: Column, rewrites: dict[str, str], bad: list[str]) -> Column:
    """A phrase as a label: rewritten where that is known; null for one with a bad word or a number."""
    words = F.split(F.lower(phrase), " ")
    poor = F.exists(words, lambda w: w.isin(bad) | w.rlike("^[0-9]+$"))
    return F.when(~poor, F.coalesce(_lookup(F.lower(phrase), rewrites), phrase))
