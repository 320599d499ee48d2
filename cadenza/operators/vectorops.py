"""Vector tables: feature vectors, comparison, pooling, merging, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vectors
from cadenza.functions.vectors import distance, unit
from cadenza.operators import knn

EXACT, NEAR, SIMILAR = 0.99, 0.90, 0.70
SAMPLE_LENGTH = 16


def match_type(similarity: Column) -> Column:
    return (F.when(similarity >= EXACT, "exact").when(similarity >= NEAR, "near_duplicate").when(similarity >= SIMILAR, "similar")
            .otherwise("low_similarity"))


def similar_items(items: DataFrame, k: int = 10, min_similarity: float = 0.5, item_id: str = "vec_id", vector: str = "embedding",
                  probes: int | None = None, recall: float | None = None) -> DataFrame:
    """(item, other, similarity, rank, match_type) of the nearest others of each item; with `probes` or `recall` approximate."""
    base = items.select(item_id, unit(F.col(vector)).alias(vector))
    found = knn.search(base.withColumnRenamed(item_id, "_query"), base, k, "_query", item_id, vector, probes=probes, recall=recall, skip=lambda q, x: q["_query"] == x[item_id])
    raw = 1 - F.col("distance") * F.col("distance") / 2
    out = found.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).filter(F.col("similarity") >= min_similarity)
    return out.select(F.col("_query").alias(item_id), F.col(item_id).alias("other"), "similarity", "rank", match_type(F.col("similarity")).alias("match_type"))


def compare_pairs(pairs: DataFrame, items: DataFrame, item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs (a, b) with their cosine similarity in [0, 1]; pairs with a missing side drop out."""
    a = items.select(F.col(item_id).alias("a"), F.col(vector).alias("_va"))
    b = items.select(F.col(item_id).alias("b"), F.col(vector).alias("_vb"))
    sim = vectors.cosine(F.col("_va"), F.col("_vb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim)).alias("similarity"))


def _with_previous(ranked: DataFrame, previous: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str) -> DataFrame:
    own = items.select(item_id, F.col(vector).alias("_v"))
    before = items.select(F.col(item_id).alias("previous_id"), F.col(vector).alias("_p"))
    return ranked.join(own, item_id).join(previous, query_id, "left").join(before, "previous_id", "left")


def rerank_by_continuity(ranked: DataFrame, previous: DataFrame, items: DataFrame, weight: float = 0.4, query_id: str = "query_id",
                         item_id: str = "vec_id", vector: str = "embedding", jitter: str | None = None) -> DataFrame:
    """Best candidate by (1 - weight) * target distance + weight * distance to the previous pick.

    With `jitter` (a salt) one of the best three is taken, chosen by a hash.
    """
    weight = max(0.0, min(1.0, weight))
    joined = _with_previous(ranked, previous, items, query_id, item_id, vector)
    gap = distance(F.col("_p"), F.col("_v"))
    score = F.when(F.col("_p").isNull(), F.col("distance")).otherwise((1 - weight) * F.col("distance") + weight * gap)
    scored = joined.select(query_id, item_id, score.alias("score"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.round("score", 9), item_id))
    top = scored.withColumn("_place", place).filter(F.col("_place") <= (3 if jitter else 1))
    if jitter:
        count = F.count(F.lit(1)).over(Window.partitionBy(query_id))
        chosen = F.floor(vectors.uniform(F.col(query_id), jitter) * F.col("_count")) + 1
        top = top.withColumn("_count", count).filter(F.col("_place") == chosen).drop("_count")
    return top.drop("_place")


def stateless_terms(ranked: DataFrame, previous: DataFrame, items: DataFrame, query_id: str = "query_id", item_id: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """Candidates with relevance (relative to the farthest one) and continuity."""
    joined = _with_previous(ranked, previous, items, query_id, item_id, vector)
    top = F.greatest(F.max("distance").over(Window.partitionBy(query_id)), F.lit(0.001))
    gap = distance(F.col("_p"), F.col("_v"))
    return joined.withColumn("relevance", 1 - F.col("distance") / top).withColumn(
        "continuity", F.coalesce(F.greatest(F.lit(0.0), 1 - gap / 5.0), F.lit(0.5)))


def clip_vectors(rows: DataFrame, clip_id: str = "clip_id") -> DataFrame:
    """(clip_id, embedding, is_imputed) from joined motion, mood and colour columns."""

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    present = [c for c in ("motion_score", "motion_type", "energy", "moods") if c in rows.columns]
    imputed = F.lit(True)
    for c in present:
        imputed = imputed & F.col(c).isNull()
    own = vectors.feature_vector(
        col("motion_score", "double"), col("energy", "double"), col("motion_type", "string"), col("moods", "array<string>"),
        col("camera_magnitude", "double"), col("brightness_dynamics", "double"), col("color_dynamics", "double"), col("temporal_rhythm", "string"))
    vector = F.when(imputed, vectors.imputed_vector(F.col(clip_id))).otherwise(own)
    return rows.select(clip_id, vector.alias("embedding"), imputed.alias("is_imputed"))


def query_vectors(targets: DataFrame, target_id: str = "query_id") -> DataFrame:
    """Query vectors of targets (motion_score, energy, motion_type, moods)."""
    out = targets.select(target_id, vectors.feature_vector(
        F.col("motion_score"), F.col("energy"), F.col("motion_type"), F.col("moods"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit("STEADY")).alias("embedding"))
    return out


def mean_pool(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per group; sums per position are combined before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    # one entry per vector position
    lists = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda e: e["_x"]).alias(vector))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows without a stored counterpart."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def merge_latest(kept: DataFrame, fresh: DataFrame, keys: Sequence[str], version: str, dropped: DataFrame | None = None) -> DataFrame:
    """Highest version per key; `dropped` keys leave the kept side."""
    if dropped is not None:
        kept = kept.join(dropped, list(keys), "left_anti")
    both = kept.unionByName(fresh)
    rest = [c for c in both.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(version))
    return both.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def fingerprint(payload: Column) -> Column:
    return F.substring(F.sha2(payload, 256), 1, 16)


def sampled_fingerprint(payload: Column, header: Sequence[Column], length: int = SAMPLE_LENGTH) -> Column:
    """16 hex digits over a header and samples at 0, 1/4, 1/2 and 3/4 of the payload."""
    n = F.length(payload)
    starts = [F.lit(1), F.floor(n / 4) + 1, F.floor(n / 2) + 1, F.floor(n * 3 / 4) + 1]
    samples = [payload.substr(s.cast("int"), F.lit(length)) for s in starts]
    return fingerprint(F.concat_ws("_", *header, *samples))


def verify(payload: Column, expected: Column) -> Column:
    return F.coalesce(fingerprint(payload) == expected, F.lit(False))
