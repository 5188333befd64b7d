"""Column builders for links between papers and artifacts: URL classes, trust, reference types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text

# Hosts of code repositories and what a repository there is called.
REPOSITORIES = [("github.com", "github"), ("gitlab.com", "gitlab"), ("bitbucket.org", "bitbucket"), ("codeberg.org", "codeberg")]
# First path segments that are no owner.
GITHUB_RESERVED = ["topics", "features", "marketplace", "collections", "search", "orgs", "apps", "pricing"]
HUGGINGFACE_RESERVED = ["api", "docs", "datasets", "spaces", "models", "papers", "blog", "pricing", "settings"]
# Hosts of papers and publishers, which are no artifacts of a generic kind.
BIBLIOGRAPHIC = [
    "arxiv.org", "doi.org", "dx.doi.org", "openalex.org", "semanticscholar.org", "api.semanticscholar.org",
    "crossref.org", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "aclanthology.org", "openreview.net",
    "api.openreview.net", "api2.openreview.net", "portal.acm.org", "dl.acm.org", "acm.org", "springerlink.com",
    "link.springer.com", "ieeexplore.ieee.org", "proceedings.neurips.cc", "papers.nips.cc", "proceedings.mlr.press",
    "openaccess.thecvf.com", "w3.org",
]
# What a trusted observation of a link needs. Types that their provider vouches for; fields that a generic
# link may come from; hosts that are never artifacts; hosts of papers, publishers and resolvers.
TRUST_POLICY = "artifact_trusted_links_policy_v1"
TRUSTED_TYPES = [
    "github_repository", "gitlab_repository", "bitbucket_repository", "codeberg_repository", "huggingface_model",
    "huggingface_dataset", "huggingface_space", "figshare_artifact", "zenodo_artifact", "youtube_video", "kaggle_dataset",
]
TRUSTED_FIELDS = ["comment", "code_links", "dataset_links", "model_links", "repo_url"]
NOISE_HOSTS = ["w3.org"]
RESOLVER_HOSTS = [
    "arxiv.org", "doi.org", "dx.doi.org", "openalex.org", "semanticscholar.org", "api.semanticscholar.org",
    "crossref.org", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "aclanthology.org", "openreview.net",
    "api.openreview.net", "api2.openreview.net", "portal.acm.org", "dl.acm.org", "acm.org", "springerlink.com",
    "link.springer.com", "ieeexplore.ieee.org", "proceedings.neurips.cc", "papers.nips.cc", "proceedings.mlr.press",
    "openaccess.thecvf.com", "hdl.handle.net", "nbn-resolving.de", "imstat.org",
]


def classify_url(url: Column, relation: Column | None = None) -> Column:
    """struct(artifact_type, provider, normalized_url, external_id, owner, name); null where no rule holds.

    Ordered rules of host and path; a repository needs owner and name, and reserved owners are none.  A URL of
    another host is generic, and only if its relation is known, it is no PDF and no page of a paper.
    """
    relation = F.lit("unknown") if relation is None else F.coalesce(relation, F.lit("unknown"))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    part, n = (lambda i: F.get(parts, F.lit(i))), F.size(parts)
    none = F.lit(None).cast("string")

    def found(kind, provider: str, at: Column, external: Column, owner: Column, name: Column) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return F.struct(kind.alias("artifact_type"), F.lit(provider).alias("provider"), at.alias("normalized_url"), external.alias("external_id"), owner.alias("owner"), name.alias("name"))

    def joined(*xs: Column) -> Column:
        return F.concat_ws("/", *xs)

    rules = []
    repo = F.regexp_replace(part(1), r"\.git$", "")
    for site, provider in REPOSITORIES:
        ok = (host == site) & (n >= 2)
        if provider == "github":
            ok = ok & (repo != "") & ~F.lower(part(0)).isin(GITHUB_RESERVED)
        rules.append((ok, found(f"{provider}_repository", provider, joined(F.lit(f"https://{site}"), part(0), repo), joined(part(0), repo), part(0), repo)))
    hub = F.lit("https://huggingface.co")
    for first, kind in (("datasets", "huggingface_dataset"), ("spaces", "huggingface_space")):
        rules.append(((host == "huggingface.co") & (n >= 3) & (part(0) == first), found(kind, "huggingface", joined(hub, part(0), part(1), part(2)), joined(part(0), part(1), part(2)), part(1), part(2))))
    rules.append(((host == "huggingface.co") & (n >= 2) & ~part(0).isin(HUGGINGFACE_RESERVED), found("huggingface_model", "huggingface", joined(hub, part(0), part(1)), joined(part(0), part(1)), part(0), part(1))))
    video = F.regexp_extract(F.trim(url), r"[?&]v=([^&#]+)", 1)
    watch = lambda v: F.concat(F.lit("https://www.youtube.com/watch?v="), v)
    rules.append((host.isin("youtube.com", "m.youtube.com") & (part(0) == "watch") & (video != ""), found("youtube_video", "youtube", watch(video), video, none, video)))
    rules.append(((host == "youtu.be") & (n >= 1), found("youtube_video", "youtube", watch(part(0)), part(0), none, part(0))))
    rules.append(((host == "kaggle.com") & (n >= 3) & (part(0) == "datasets"), found("kaggle_dataset", "kaggle", joined(F.lit("https://kaggle.com/datasets"), part(1), part(2)), joined(part(1), part(2)), part(1), part(2))))
    rules.append(((host == "zenodo.org") & (n >= 2) & part(0).isin("record", "records"), found("zenodo_artifact", "zenodo", joined(F.lit("https://zenodo.org/records"), part(1)), part(1), none, part(1))))
    plain = F.concat(F.lit("https://"), host, F.regexp_replace(path, "/+$", ""))
    last = F.when(n > 0, F.element_at(parts, -1))
    rules.append((host.endswith("figshare.com"), found("figshare_artifact", "figshare", plain, plain, none, last)))
    rules.append((F.lower(path).endswith(".pdf") | (host == "") | (relation == "unknown") | host.isin(BIBLIOGRAPHIC), None))
    kind = F.when(relation.isin("code", "dataset", "model"), F.concat(F.lit("generic_"), relation, F.lit("_url"))).otherwise("generic_artifact_url")
    other = found(kind, "generic", plain, plain, none, F.coalesce(last, host))
    out = F.when(*rules[0])
    for test, value in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(other)


def relation_of_type(artifact_type: Column, fallback: Column) -> Column:
    """The relation that a kind of artifact stands for."""
    t = artifact_type
    return F.when(t.contains("dataset"), "dataset").when(t.contains("model"), "model").when(t.contains("space") | t.contains("youtube") | t.contains("video"), "demo").when(t.contains("repository") | (t == "generic_code_url"), "code").otherwise(F.coalesce(fallback, F.lit("unknown")))


def trusted(kind: Column, confidence: Column, field: Column, host: Column, types: list[str], fields: list[str], denied: list[str]) -> Column:
    """A known type at 0.65 or more; a generic one at 0.9 or more from a named field and a host that isn't denied."""
    generic = (kind == "generic") & (confidence >= 0.9) & field.isin(fields) & ~text.in_domain(host, denied)
    return F.coalesce((kind.isin(types) & (confidence >= 0.65)) | generic, F.lit(False))


def trusted_observation(types: list[str] = TRUSTED_TYPES, fields: list[str] = TRUSTED_FIELDS) -> Column:
    """Whether an observation row stands for a link: canonical_id, artifact_id, artifact_type, provider, relation_type, source_field, confidence, normalized_url."""
    host = text.url_host(F.col("normalized_url"))
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    known = given("canonical_id") & given("artifact_id") & ~F.col("relation_type").eqNullSafe("unknown") & ~F.coalesce(text.in_domain(host, NOISE_HOSTS), F.lit(False))
    generic = (F.col("provider") == "generic") & (sure >= 0.9) & F.col("source_field").isin(fields) & ~F.coalesce(text.in_domain(host, RESOLVER_HOSTS), F.lit(False))
    kind = F.coalesce(F.col("artifact_type").isin(types), F.lit(False))
    return F.coalesce(known & F.when(kind, sure >= 0.65).otherwise(generic), F.lit(False))


def reference_type(value: Column, explicit: Column | None = None) -> Column:
    """The explicit type by alias, else by the value's form."""
    v = F.lower(F.trim(value))
    inferred = F.when(v.rlike(r"openalex\.org/w[0-9]+|^w[0-9]{5,}$"), "openalex").when(v.rlike(r"^[0-9a-f]{40}$|semanticscholar"), "s2").when(v.rlike(r"arxiv|^[0-9]{4}\.[0-9]{4,5}"), "arxiv").when(v.rlike(r"10\.[0-9]{4,9}/"), "doi").otherwise("raw")
    if explicit is None:
        return inferred
    e = F.lower(explicit)
    return F.when(e.isin("doi", "crossref"), "doi").when(e.isin("arxiv", "arxiv_id"), "arxiv").when(e.isin("openalex", "openalex_id"), "openalex").when(e.isin("s2", "semantic_scholar", "corpusid"), "s2").otherwise(inferred)


def feature_trusted(relation: Column, confidence: Column, artifact_type: Column, relations: list[str], bars: dict[str, float], bar: float) -> Column:
    """What counts as a feature: a listed relation, and the confidence that its type asks for. Hosts don't matter here."""
    needed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in bars.items() for x in kv]), artifact_type), F.lit(bar))
    return F.coalesce(relation.isin(relations) & (confidence >= needed), F.lit(False))
