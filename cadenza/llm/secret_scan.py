"""Secrets in texts: sure patterns, and weak parts that count only beside their complements. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize

#: kind: (pattern, least length of group, group). The order is that of `spans`; the first three are sure.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),
    "identifier": (r"""\b(?:(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,})""", 1, 0),
    "opaque": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}={0,2}", 24, 0),
    "endpoint": (r"(?i:(?:postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\s\"'<>]{4,}|(?:https?|ftp)://(?:[^\s\"'<>/@:]+(?::[^\s\"'<>/@]*)?@[^\s\"'<>]+|[^\s\"'<>/:@]+:[0-9]{2,5}\b[^\s\"'<>]*))", 1, 0),
    "short": (r"""\b(?i:(?:[a-z]+[_-])?(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,11})(?![A-Za-z0-9+/_.=-])""", 4, 1),
    "letters": (r"(?<![A-Za-z0-9+/_-])(?=(?:[a-z+/_-]*+[A-Z]){2})(?=(?:[A-Z+/_-]*+[a-z]){2})[A-Za-z+/_-]{32,}(?![A-Za-z0-9+/_-])={0,2}", 32, 0),
    "link": (r"(?i:https?|ftp)://[^\s\"'<>]{4,}", 1, 0),
}
SURE = ("assign", "access", "hex")
#: what a kind is to the linking: an access identifier, a secret or an endpoint; a plain link is no complement of others
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "opaque": "secret", "endpoint": "endpoint", "short": "secret", "letters": "secret", "link": "link"}
#: a weak kind is reported if one of these parts lies within the scope
NEEDS = {"identifier": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("secret",), "short": ("identifier",), "letters": ("identifier",), "link": ("identifier", "secret")}
#: kinds that need all of their parts: an ordinary link beside a hash alone is no secret
NEEDS_ALL = ("link",)


def found_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, kind, size) of a kind's matches, in code points, leftmost and not overlapping; size is that of the group that is judged.

    Places follow from the lengths of the matches and of the text between
    them, which the same pattern splits.
    """
    pattern, least, group = KINDS[kind]
    order = list(KINDS).index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sized = F.zip_with(F.transform(hits, lambda h: F.length(h)), F.transform(judged, lambda j: F.length(j)), lambda h, j: F.struct(h.alias("h"), j.alias("j")))
    both = F.zip_with(gaps, sized, lambda g, s: F.struct(g.alias("gap"), F.coalesce(s["h"], F.lit(0)).alias("hit"), F.coalesce(s["j"], F.lit(0)).alias("size")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,size:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda s, m: F.struct(
        (s["at"] + m["gap"] + m["hit"]).alias("at"),
        F.when(m["size"] >= least, F.concat(s["out"], F.array(F.struct(
            (s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["hit"]).alias("end"), F.lit(order).alias("kind"), m["size"].alias("size"))))).otherwise(s["out"]).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(both, state, step, lambda s: s["out"])).otherwise(empty)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sure, weak) of each row: arrays of spans by start, then kind; key stands for the text.

    Weak spans that overlap a sure one, an endpoint, a link or a short value
    are left out, and so is an opaque one within an identifier: a value is not
    its own complement. Each weak span is held against the others of its text;
    there are few of them in texts other than lists of secrets.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    step = rows.select("doc_id", F.md5("text").alias("key"), *[found_spans(text, k).alias(k) for k in KINDS])
    step = step.withColumn("sure", F.array_sort(F.concat(*[F.col(k) for k in SURE])))
    taken = ["sure"]
    for kind in ("endpoint", "link", "identifier", "short", "opaque", "letters"):
        step = step.withColumn(kind, F.filter(kind, lambda w: ~reduce(or_, [F.exists(t, lambda s: _overlap(w, s)) for t in taken])))
        if kind in ("endpoint", "link", "short"):
            taken.append(kind)
    inside = lambda c: F.filter(c, lambda w: ~F.exists("identifier", lambda s: (s["start"] <= w["start"]) & (w["end"] <= s["end"])))
    return step.select("doc_id", "key", "sure", F.array_sort(F.concat("endpoint", "link", "identifier", "short", inside("opaque"), inside("letters"))).alias("weak"))


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """(key, linked): per text the weak spans that have a complement starting within `scope` code points.

    An interval join on bins of the scope's width: per text, part and bin only
    the first and last start are kept, and a weak span looks at its own bin
    (always within the scope), the last start of the bin before and the first
    of the bin after. So nothing is paired with all of a text's spans. Equal
    texts are linked once.
    """
    names = F.array(*[F.lit(PARTS[k]) for k in KINDS])
    some = found.filter(F.size("weak") > 0).select("key", "sure", "weak").dropDuplicates(["key"])
    spans = some.select("key", F.explode(F.concat("sure", "weak")).alias("s")).select(
        "key", F.get(names, F.col("s.kind")).alias("part"), F.col("s.start").alias("start"), F.floor(F.col("s.start") / scope).cast("int").alias("bin"))
    bins = spans.groupBy("key", "part", "bin").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.array(*[F.array(*[F.lit(p) for p in NEEDS.get(k, ("",))]) for k in KINDS])
    weak = some.select("key", F.explode("weak").alias("w")).withColumn("part", F.explode(F.get(needs, F.col("w.kind"))))
    weak = weak.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(
        "bin", F.floor(F.col("w.start") / scope).cast("int") + F.col("side"))
    near = weak.join(bins, ["key", "part", "bin"]).filter(
        "side = 0 OR (side < 0 AND last >= w.start - " + str(int(scope)) + ") OR (side > 0 AND first <= w.start + " + str(int(scope)) + ")")
    met = near.groupBy("key", "w").agg(F.count_distinct("part").alias("_parts"))
    every = [list(KINDS).index(k) for k in NEEDS_ALL]
    met = met.filter(~F.col("w.kind").isin(every) | (F.col("_parts") > 1))
    return met.groupBy("key").agg(F.array_sort(F.collect_set("w")).alias("linked"))


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(doc_id, key, sure, linked) of each row: sure spans, and weak spans beside their complements.

    Null text is the empty text, without spans; places are code points, ends
    exclusive. Rows are matched to links by text, so repeated ids and rows are
    no trouble. An empty table gives no rows; other columns are not read.
    """
    found = materialize(candidates(docs), "spans")
    links = linked(found, scope).withColumnRenamed("key", "_key")
    none = F.array().cast("array<struct<start:int,end:int,kind:int,size:int>>")
    joined = found.join(links, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", "key", "sure", F.coalesce("linked", none).alias("linked"))


def report(docs: DataFrame, scope: int = 400) -> DataFrame:
    """Counts of the sure kinds and the digest of their spans, with all spans as text."""
    order = list(KINDS)
    count = lambda kind: F.size(F.filter("sure", lambda s: s["kind"] == order.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs, scope).select(
        "doc_id", *[count(k) for k in SURE], F.sha2(_as_text(F.col("sure")), 256).alias("base_sha256"),
        _as_text(F.array_sort(F.concat("sure", "linked"))).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "<secret>", scope: int = 400) -> DataFrame:
    """`docs` with every span replaced by `mark` (touching and overlapping ones by one) and n_chars brought up to date."""
    spans = scan(docs, scope).filter(F.size("sure") + F.size("linked") > 0).select(
        F.col("key").alias("_key"), F.array_sort(F.concat("sure", "linked")).alias("_spans")).dropDuplicates(["_key"])
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_k", F.md5("_text"))
    keyed = keyed.join(spans, F.col("_k") == F.col("_key"), "left")
    cut = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] > s["at"], F.concat(s["out"], F.substring("_text", s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))
        .when(s["out"] == "", F.lit(mark)).otherwise(s["out"]).alias("out"))
    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
                        lambda s: F.concat(s["out"], F.substring("_text", s["at"] + 1, F.length("_text"))))
    whole = keyed.withColumn("_clean", clean)
    changed = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    kept = lambda c: F.col("row")[c]
    return whole.select(*[F.when(F.col("_spans").isNull(), kept(c)).otherwise(changed[c]).alias(c) if c in changed else kept(c).alias(c) for c in docs.columns])
