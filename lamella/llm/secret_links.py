"""Secret scanning with multipart credential linking.

Three base detectors (assignments, access identifiers, long hex) report every match.
Three weak detectors (logins, endpoints, blobs of letters and digits) find parts that
say little alone: they are reported only when complementary parts stand within the same
scope of one text, that is, start within ``SCOPE`` code points of their start. A login needs
a secret, a blob needs an identifier or an endpoint, an endpoint needs both an identifier
and a secret.

The scopes are joined as intervals: each text is divided into cells of ``SCOPE`` code
points, parts of one role are pre-aggregated per cell to their first and last start, and
each weak part is joined with its own and the two neighbouring cells. That is one row per
cell and role, whatever the number of parts, and it is exact. Texts never shuffle: only
parts do, and only those of texts that have any.

Special rows: a null text counts as empty and has no parts; null doc_ids are kept;
repeated rows give equal results; extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import whole_text
from lamella.plans.spool import spool

SCOPE = 256

#: Kind, role, pattern, least length of the whole match, group and its least length. A blob
#: also needs a digit (``DIGIT``) anywhere in its match.
DETECTORS = [
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 6),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 20, 0, 0),
    ("hex", "secret", r"[0-9a-f]{24,}", 24, 0, 0),
    ("login", "identifier", r"""(?i:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 0, 0, 0),
    ("endpoint", "endpoint", r"""(?:https?|wss?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", 0, 0, 0),
    ("blob", "secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}", 20, 0, 0),
]
KINDS = [d[0] for d in DETECTORS]
BASE = 3
DIGIT = {"blob"}


def matches(text: Column, number: int) -> Column:
    """The detector's leftmost matches: kind, nth, code points since the match before, length, whether it holds.

    Splitting at the pattern gives the text between the matches, whose lengths place them.
    """
    kind, _, pattern, least, group, group_least = DETECTORS[number]
    digit = (lambda whole: whole.rlike("[0-9]")) if kind in DIGIT else (lambda whole: F.lit(True))
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    each = F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), held.alias("held")),
        lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), F.length(m["whole"]).alias("length"), ((F.length(m["whole"]) >= least) & (F.length(m["held"]) >= group_least) & digit(m["whole"])).alias("holds")),
    )
    return F.when(text.rlike(pattern), each)


def parts_by_text(docs: DataFrame) -> DataFrame:
    """doc_id, key (null: no match), found: the matches of each text, without the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,length:int,holds:boolean>>")
    found = F.concat(*(F.coalesce(matches(F.col("text"), k), none) for k in range(len(DETECTORS))))
    keyed = rows.select("doc_id", "text", found.alias("found"))
    return keyed.select("doc_id", F.when(F.size("found") > 0, F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))).alias("key"), "found")


def placed(found: DataFrame) -> DataFrame:
    """key, kind, start, end, role of each match that holds."""
    once = found.where("key is not null").select("key", "found").dropDuplicates(["key"])
    each = once.select("key", F.explode("found").alias("m")).select("key", "m.*")
    so_far = Window.partitionBy("key", "kind").orderBy("nth")
    start = F.sum(F.col("gap") + F.col("length")).over(so_far) - F.col("length")
    roles = F.element_at(F.array(*(F.lit(d[1]) for d in DETECTORS)), F.col("kind") + 1)
    return each.withColumn("start", start).where("holds").select("key", "kind", "start", (F.col("start") + F.col("length")).alias("end"), roles.alias("role"))


def apart(parts: DataFrame) -> DataFrame:
    """Without blobs that overlap a base match or an endpoint. Logins and endpoints stay, even within a base match."""
    firm = F.col("kind") < BASE
    solid = firm | (F.col("kind") == KINDS.index("endpoint"))
    ahead = Window.partitionBy("key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    blob = F.col("kind") == KINDS.index("blob")
    seen = parts.withColumn("last_end", F.max(F.when(solid, F.col("end"))).over(ahead)).withColumn("next_start", F.min(F.when(solid, F.col("start"))).over(behind))
    hit = blob & (F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False)))
    return seen.where(~hit).select("key", "kind", "start", "end", "role")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with complementary parts in their scope: key, kind, start, end."""
    cells = parts.groupBy("key", F.floor(F.col("start") / scope).alias("cell"), "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    weak = parts.where(F.col("kind") >= BASE).select("key", "kind", "start", "end", F.explode(F.array(*(F.floor(F.col("start") / scope) + k for k in (-1, 0, 1)))).alias("cell"))
    near = weak.join(cells, ["key", "cell"]).where((F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("start") + scope))
    has = {r: F.max((F.col("role") == r).cast("int")).alias(r) for r in ("identifier", "secret", "endpoint")}
    sums = near.groupBy("key", "kind", "start", "end").agg(*has.values())
    rules = {"login": F.col("secret") == 1, "endpoint": (F.col("identifier") == 1) & (F.col("secret") == 1), "blob": (F.col("identifier") == 1) | (F.col("endpoint") == 1)}
    keep = F.lit(False)
    for kind, rule in rules.items():
        keep = keep | ((F.col("kind") == KINDS.index(kind)) & rule)
    return sums.where(keep).select("key", "kind", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans: the reported spans of each document as an array of (start, kind, end), in that order."""
    found = spool(parts_by_text(docs), "secret-parts")
    parts = spool(apart(placed(found)), "secret-places")
    reported = parts.where(F.col("kind") < BASE).select("key", "kind", "start", "end").unionByName(linked(parts, scope))
    by_text = reported.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = found.select("doc_id", "key")
    some = rows.where("key is not null").join(by_text, "key", "left").select("doc_id", "spans")
    none = rows.where("key is null").select("doc_id", F.lit(None).cast(by_text.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none).select("doc_id", F.coalesce("spans", F.array().cast(by_text.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < BASE)
