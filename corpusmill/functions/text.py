"""Column builders for identity and text normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that topic labels leave out.
STOPWORDS = "the and for with that this from are was its our can has have into using based via between of in on to is by as an or we".split()


def normalize_text(c: Column) -> Column:
    """Stripped, runs of white space as one space; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def stable_hash(c: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def content_hash(title: Column, abstract: Column) -> Column:
    return stable_hash(F.concat(normalize_text(title), F.lit("\n"), normalize_text(abstract)))


def joined_md5(*parts: Column) -> Column:
    """MD5 of the parts joined by line breaks, null as empty."""
    return F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def edge_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 20)


# Schemes whose URLs have a host part even where it is empty.
HOSTED = ["http", "https", "ftp", "sftp", "file"]


def _decoded(c: Column) -> Column:
    """Form decoding; what isn't an escape stays."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(c: Column) -> Column:
    """Lower-case scheme (https if there is none) and host; no trailing slash but the root's; query pairs sorted and encoded anew; no fragment or parameters."""
    c = F.regexp_replace(F.trim(c), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")).otherwise(c)
    host = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, r"^//[^/?]*", ""), r"^([^?]*)", 1), r";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    pair = lambda x: F.struct(_decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair))
    query = F.array_join(F.transform(pairs, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    place = F.when((host != "") | (scheme.isin(HOSTED) & ~path.startswith("//")), F.concat(F.lit("//"), host, F.when((path != "") & ~path.startswith("/"), "/").otherwise(""), path)).otherwise(path)
    return F.concat(scheme, F.lit(":"), place, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def in_domain(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    return F.coalesce(F.array_contains(F.array(*[F.lit(d) for d in domains]), host) | F.exists(F.array(*[F.lit("." + d) for d in domains]), lambda d: F.endswith(host, d)), F.lit(False))


def title_key(c: Column) -> Column:
    """Lower case, then single spaces, then no punctuation: the order matters."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[^\p{L}\p{N}_\s]", "")


def doi_key(c: Column) -> Column:
    """The one DOI in a value, trimmed of punctuation; null for none or several."""
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(10\.[0-9]{4,9}/[^\s\"<>]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:)\]]+$", ""))
    one = F.array_distinct(found)
    return F.when(F.size(one) == 1, F.element_at(one, 1))


def arxiv_key(c: Column) -> Column:
    """arXiv id without its version; null if there's none."""
    got = F.regexp_extract(F.lower(F.trim(c)), r"([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})(v[0-9]+)?$", 1)
    return F.when(got != "", got)


def map_lookup(m: Column, key: str) -> Column:
    """First non-empty value whose key equals key in any case."""
    found = F.filter(F.map_entries(m), lambda e: (F.lower(e["key"]) == key.lower()) & e["value"].isNotNull() & (e["value"] != ""))
    return F.get(found, F.lit(0))["value"]


def extract_urls(c: Column) -> Column:
    """http(s) and www. URLs of a text without trailing punctuation, in order."""
    found = F.regexp_extract_all(c, F.lit(r"((?:https?://|www\.)[^\s<>\"')\]]+)"), F.lit(1))
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>'\"”’»]+$", ""))
    return F.transform(trimmed, lambda u: F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))


def tokens(c: Column) -> Column:
    """Unicode words, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def topic_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces. The words are bound as a lambda's variable: named in the inner lambda, they'd be computed anew for each place."""
    places = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    runs = lambda w: F.transform(places(w), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def length_class(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 50, "very_short").when(n < 150, "short").when(n < 300, "medium").otherwise("long")


def count_bucket(n: Column) -> Column:
    return F.when(n.isNull(), "missing").when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def merge_unique(values: Column) -> Column:
    """Distinct in any case; the first spelling stays, in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)) | v.isNull() | (F.trim(v) == ""), acc).otherwise(F.concat(acc, F.array(v))))


def detects(text: Column, *phrases: str) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | t.contains(p)
    return out


def parse_datetime(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def abstract_of(index: Column) -> Column:
    """Text from a map of word to its positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def relation_of(field: Column) -> Column:
    """Kind of link that a field's name or text speaks of; the first that matches counts."""
    f = F.lower(field)
    return F.when(f.contains("code") | f.contains("github") | f.contains("repo"), "code").when(f.contains("data"), "dataset").when(f.contains("model") | f.contains("checkpoint"), "model").when(f.contains("demo") | f.contains("space"), "demo")
