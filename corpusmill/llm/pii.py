"""Personal data spans: weak supervision over regular expressions, gazetteers and context.

Candidates are the base spans (email, ip, card, phone, by strict patterns and
checks) and looser ones: 13 to 19 digits that fail the card checksum, telephone
numbers without a country code, spelled-out email addresses, and addresses with
masked dots or of the longer kind.  Four labelers vote on each: its form, a
gazetteer (top-level domains, card issuers, country codes, reserved address
ranges), words just before it, and the grouping of its characters.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability by kind.  Its posteriors train the final classifier, a
naive Bayes over what the labelers don't say in votes: the word before, the
shape of the characters, the length and what follows; with the posterior as
prior it judges the loose candidates, and those more likely than not are added.
Base spans always stay, and an added span never overlaps one.

The driver sees counts of vote patterns and hashed features only, at most
4 * 16 * 781 numbers whatever the table.

DataFrame operations only.  Matches are found by regexp_extract_all without
nested backtracking; a match is a row, and its place is a running sum of the
lengths of the pieces between matches, so a text takes time in proportion to its
length and its matches.  Places are code points.

A null text is empty.  Rows are judged one by one; repeated rows vote as often
as they occur.  An empty table adds nothing.  Other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import frames

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans. A match can start only where no
# longer one could have, and repeated groups are possessive, so that long runs
# take neither quadratic time nor stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The looser ones.
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}"
MASKED = r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}){3}(?![0-9.])"
LONG_IP = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"

# The gazetteers.
DOMAINS = "com org net edu gov io info biz eu de at ch fr be es mx it nl uk us ca au jp cn in br pl se no dk fi".split()
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|33|34|49)"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
CONTEXT = {"email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)\W{0,3}\w{0,8}\W{0,3}$", "ip": r"(?i)(?:ip|addr|host|server|from)\w{0,6}\W{0,3}$", "card": r"(?i)(?:card|visa|credit|pay|karte|tarjeta|carte)\w{0,6}\W{0,3}$", "phone": r"(?i)(?:tel|phone|call|fon|mobil|fax|llam|appel)\w{0,6}\W{0,3}$"}

LABELERS = ("form", "gazetteer", "context", "grouping")
#: Characters of the parts that a text is cut into to be put together anew.
PART = 4096
#: Features of the classifier and how many values each has.
FEATURES = {"word": 512, "shape": 256, "length": 8, "next": 5}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    digit = lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48
    twice = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(i)).otherwise(digit(i)))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substring(part(p), 1, 3)), F.lit("9999")).cast("int"), F.lit(0)) <= 255))


def hits(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns to keep, and hits: for each match of each pattern its number, the length of the piece before it, the match and what is around it.

    To be written before it is filtered: a filter would be pushed below and split the text anew for each match.
    """
    text = F.col("text")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    digit = text.rlike("[0-9]")
    dot = text.contains("(dot)") | text.contains("[dot]") | text.contains(" dot ")
    at = text.contains("(at)") | text.contains("[at]") | dot
    masked = digit & (dot | text.contains("[.]") | text.contains("(.)") | text.rlike(r"[0-9] \.|[0-9]\. [0-9]"))
    patterns = {"email": (EMAIL, text.contains("@")), "ip": (IP, digit), "card": (CARD, digit), "phone": (PHONE, text.contains("+")), "local": (LOCAL, digit), "spelled": (SPELLED, at), "masked": (MASKED, masked), "long_ip": (LONG_IP, digit & text.contains(":"))}
    rows = rows.select("*", *[F.when(g, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k}") for k, (p, g) in patterns.items()])
    rows = rows.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, (p, _) in patterns.items()])

    def struct(k: str):
        def one(m: Column, i: Column) -> Column:
            gap = F.get(f"g_{k}", i)
            before = F.right(F.concat(F.when(i > 0, F.get(f"m_{k}", i - 1)).otherwise(F.lit("")), gap), F.lit(24))
            return F.struct(F.lit(k).alias("pattern"), i.alias("i"), F.length(gap).alias("chars"), m.alias("m"), before.alias("before"), F.left(F.get(f"g_{k}", i + 1), F.lit(1)).alias("after"))

        return F.transform(f"m_{k}", one)

    return rows.select(*keep, F.concat(*[struct(k) for k in patterns]).alias("hits"))


def spans(rows: DataFrame) -> DataFrame:
    """(rid, kind, s, e, base, votes' code, features): base spans, and loose ones that overlap none."""
    each = rows.select("rid", F.inline("hits"))
    w = Window.partitionBy("rid", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("m")
    each = each.withColumn("e", F.sum(F.col("chars") + F.length(m)).over(w).cast("int"))
    each = each.withColumn("s", F.col("e") - F.length(m))
    p, n = F.col("pattern"), F.length(_digits(m))
    kind = F.when(p == "local", "phone").when(p == "spelled", "email").when(p.isin("masked", "long_ip"), "ip").otherwise(p)
    sized = (n >= 13) & (n <= 19)
    luhn = F.when(sized, _luhn(_digits(m))).otherwise(False)
    base = F.when(p == "email", True).when(p == "ip", _octets(m)).when(p == "card", luhn).when(p == "phone", (n >= 9) & (n <= 15)).otherwise(False)
    each = each.withColumn("kind", kind).withColumn("base", base).where(F.col("base") | p.isin("local", "spelled", "masked", "long_ip") | ((p == "card") & sized))
    at = F.when(F.col("base"), F.col("s")).otherwise(F.col("e"))
    near = Window.partitionBy("rid").orderBy(at, F.col("base")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("e"))).over(near)  # of the base spans that begin before this one ends
    each = each.withColumn("reach", reach).where(F.col("base") | (F.coalesce("reach", F.lit(0)) <= F.col("s")))

    by = lambda **x: F.when(F.col("kind") == "email", x["email"]).when(F.col("kind") == "ip", x["ip"]).when(F.col("kind") == "card", x["card"]).otherwise(x["phone"])
    plain = F.regexp_replace(m, r" ?(?:\[dot\]|\(dot\)|\[\.\]|\(\.\)| dot |\.) ?", ".")
    form = by(email=F.regexp_replace(plain, r" ?(?:\[at\]|\(at\)| at ) ?", "@").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]{2,}(\.[A-Za-z0-9-]+)+$"), ip=(p == "long_ip") | _octets(plain), card=F.coalesce(F.col("base"), F.lit(False)), phone=F.col("base") | _digits(m).rlike("^[2-9][0-9]{2}[2-9]"))
    gazetteer = by(email=F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(DOMAINS), ip=~plain.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), card=_digits(m).rlike(ISSUERS), phone=m.rlike(COUNTRY_CODES) | _digits(m).rlike("^[2-9][0-8]"))
    context = by(**{k: F.col("before").rlike(c) for k, c in CONTEXT.items()})
    grouping = by(email=m.rlike(r"^[A-Za-z0-9]{2}") & ~m.rlike(r"\.\."), ip=~m.rlike(r"(?:^|\.)0[0-9]"), card=m.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), phone=m.rlike(r"\([0-9]{3}\)|[0-9]{3}[ .-][0-9]{4}$"))
    code = sum((F.coalesce(v, F.lit(False)).cast("int") * (1 << i) for i, v in enumerate((form, gazetteer, context, grouping))), F.lit(0))
    bucket = lambda c, of: F.pmod(F.xxhash64(c), F.lit(FEATURES[of])).cast("int")
    after = F.col("after")
    following = F.when(F.coalesce(after, F.lit("")) == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike(r"\p{L}"), 2).when(after.rlike("[0-9]"), 3).otherwise(4)
    features = F.struct(
        bucket(F.lower(F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1)), "word").alias("word"),
        bucket(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a"), "shape").alias("shape"),
        F.least(F.lit(7), F.floor(F.length(m) / 4)).cast("int").alias("length"),
        following.alias("next"),
    )
    return each.select("rid", "kind", "s", "e", "base", code.alias("code"), features.alias("features"))


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = 50) -> dict[str, dict]:
    """By kind: share of true candidates, and each labeler's rate of votes on true and on other ones, by expectation-maximisation over counts by (kind, code)."""
    out = {}
    for kind in KINDS:
        own = {c: n for (k, c), n in counts.items() if k == kind}
        prior, hit, miss = 0.5, [0.8] * len(LABELERS), [0.2] * len(LABELERS)
        for _ in range(rounds if own else 0):
            true = {c: n * posterior(c, prior, hit, miss) for c, n in own.items()}
            t, n = sum(true.values()), sum(own.values())
            prior = (t + 1) / (n + 2)
            hit = [(sum(x for c, x in true.items() if c >> i & 1) + 1.6) / (t + 2) for i in range(len(LABELERS))]
            miss = [(sum(own[c] - x for c, x in true.items() if c >> i & 1) + 0.4) / (n - t + 2) for i in range(len(LABELERS))]
        out[kind] = {"prior": prior, "hit": hit, "miss": miss}
    return out


def posterior(code: int, prior: float, hit: list[float], miss: list[float]) -> float:
    """Probability that a candidate with these votes is true."""
    odds = math.log(prior / (1 - prior))
    for i, (h, m) in enumerate(zip(hit, miss, strict=True)):
        odds += math.log(h / m) if code >> i & 1 else math.log((1 - h) / (1 - m))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


class Classifier:
    """Log odds by kind: of each vote pattern, and the naive Bayes ratio of each value of each feature."""

    def __init__(self, counts: dict[tuple[str, int, str, int], int]):
        """counts by (kind, code, feature, value)."""
        votes: dict[tuple[str, int], int] = {}
        for (kind, code, feature, _), n in counts.items():
            if feature == "length":
                votes[kind, code] = votes.get((kind, code), 0) + n
        self.reliability = reliabilities(votes)
        soft = {(k, c): posterior(c, r["prior"], r["hit"], r["miss"]) for k, r in self.reliability.items() for c in range(1 << len(LABELERS))}
        self.odds = {k: [math.log(max(soft[k, c], 1e-12) / max(1 - soft[k, c], 1e-12)) for c in range(1 << len(LABELERS))] for k in KINDS}
        self.weights = {}
        for kind in KINDS:
            for feature, size in FEATURES.items():
                true, other = [0.0] * size, [0.0] * size
                for (k, c, f, v), n in counts.items():
                    if k == kind and f == feature:
                        true[v] += n * soft[k, c]
                        other[v] += n * (1 - soft[k, c])
                t, o = sum(true), sum(other)
                self.weights[kind, feature] = [math.log((a + 0.5) / (t + 0.5 * size)) - math.log((b + 0.5) / (o + 0.5 * size)) for a, b in zip(true, other, strict=True)]

    def score(self) -> Column:
        """A span's log odds of being true."""
        of = lambda values, at: F.get(F.from_json(F.lit(json.dumps([round(x, 9) for x in values])), "array<double>"), F.col(at))
        out = F.lit(None).cast("double")
        for kind in KINDS:
            own = of(self.odds[kind], "code")
            for feature in FEATURES:
                own = own + of(self.weights[kind, feature], f"features.{feature}")
            out = F.when(F.col("kind") == kind, own).otherwise(out)
        return out


def fitted(found: DataFrame) -> Classifier:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"features.{f}").alias("v")) for f in FEATURES]))
    got = found.select("kind", "code", each.alias("x")).groupBy("kind", "code", "x.f", "x.v").count().collect()
    return Classifier({(r["kind"], r["code"], r["f"], r["v"]): r["count"] for r in got})


def _taken(rows: DataFrame) -> DataFrame:
    """Base and added spans of each row that has some."""
    found = frames.cut(spans(rows))
    return found.where(F.col("base") | (fitted(found).score() > 0))


def _order() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("o")


def find(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, base spans and all spans: arrays of (s, e, kind), by kind as listed, then start."""
    rows = frames.cut(hits(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "doc_id", "rid"))
    span = F.struct(_order(), "s", "e", "kind")
    found = _taken(rows).groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    listed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<o:bigint,s:int,e:int,kind:string>>")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))).alias(c)
    return rows.select("rid", "doc_id").join(found, "rid", "left").select("doc_id", listed("base"), listed("spans"))


def _between(parts: str, lo: Column, hi: Column) -> Column:
    """The characters from lo to hi of a text that is cut into parts of PART characters: no place is counted from the text's start."""
    a, b = F.floor(lo / PART).cast("int"), F.floor((hi - 1) / PART).cast("int")
    first, end = F.get(parts, a), F.get(parts, b)
    inner = F.when(b > a + 1, F.array_join(F.slice(parts, a + 2, b - a - 1), "")).otherwise(F.lit(""))
    across = F.concat(F.substring(first, lo - a * PART + 1, F.lit(PART)), inner, F.left(end, hi - b * PART))
    return F.when(hi <= lo, "").when(a == b, F.substring(first, lo - a * PART + 1, hi - lo)).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, if there, follows the text. Overlapping spans go as one, under the first one's kind."""
    own = {"__corpusmill_id": F.col("doc_id"), "__corpusmill_hash": F.xxhash64("text"), "__corpusmill_size": F.length("text")}
    named = docs.select("text", *[c.alias(k) for k, c in own.items()], F.monotonically_increasing_id().alias("rid"))
    rows = frames.cut(hits(named, *own, "rid")).where(F.size("hits") > 0)
    before = Window.partitionBy("rid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    each = _taken(rows).withColumn("from", F.coalesce(F.max("e").over(before), F.lit(0)))
    each = each.select("rid", F.struct("s", "e", "from", "kind").alias("x"))
    found = rows.select("rid", *own).join(each.groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("__corpusmill_spans")), "rid")
    found = frames.cut(found.dropDuplicates(list(own)).drop("rid"))
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__corpusmill_spans")), F.lit(0))).first()
    small = n <= frames.BROADCAST_ROWS // 8 and total <= frames.BROADCAST_ROWS // 2
    joined = docs.join(F.broadcast(found) if small else found, [own[k].eqNullSafe(found[k]) if k == "__corpusmill_id" else own[k] == found[k] for k in own], "left")

    has = F.col("__corpusmill_spans").isNotNull()
    joined = joined.withColumn("__corpusmill_parts", F.when(has, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    tag = lambda x: F.when(x["s"] >= x["from"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
    pieces = F.transform("__corpusmill_spans", lambda x: F.concat(_between("__corpusmill_parts", x["from"], x["s"]), tag(x)))
    last = F.element_at("__corpusmill_spans", -1)
    done = F.concat(F.array_join(pieces, ""), _between("__corpusmill_parts", F.greatest(last["e"], last["from"]), F.length("text")))
    new = F.when(has, done).otherwise(F.col("text"))
    out = joined.withColumn("__corpusmill_new", new)
    return out.select(*[F.col("__corpusmill_new").alias("text") if c == "text" else F.length("__corpusmill_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[f"`{c}`"] for c in docs.columns])
