"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.moods import MOTIONS, clamp

# fixed values: mood slots of the feature vector, in slot order
VECTOR_MOODS = [
    "ENERGETIC", "CALM", "DARK", "BRIGHT", "MELANCHOLIC", "EUPHORIC", "AGGRESSIVE", "PEACEFUL", "MYSTERIOUS", "CHEERFUL",
    "TENSE", "DREAMY", "COOL", "WARM",
]
# fixed values: rhythm slots of the feature vector
RHYTHMS = ["STEADY", "DYNAMIC", "FLASHY"]
VECTOR_DIM = 27


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector of length 1; a zero vector stays as it is."""
    v = a.cast("array<double>")
    # the norm is the variable of an outer lambda: named inside the inner one it would be summed up again for each element
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x))


def valid(a: Column, dim: int) -> Column:
    """Right length and every element finite."""
    ok = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & ok, F.lit(False))


def safe_number(x: Column, default: float = 0.0) -> Column:
    """x as a finite double, else the default."""
    d = x.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d).otherwise(F.lit(default))


def one_hot(value: Column, items: list[str], fallback: int) -> list[Column]:
    known = F.coalesce(value.isin(items), F.lit(False))
    return [F.when(F.when(known, value == item).otherwise(F.lit(i == fallback)), 1.0).otherwise(0.0) for i, item in enumerate(items)]


def feature_vector(motion_score: Column, energy: Column, motion_type: Column, moods: Column, camera: Column,
                   brightness_dynamics: Column, color_dynamics: Column, rhythm: Column) -> Column:
    """27 features: levels, motion class, moods, camera, dynamics and rhythm."""
    mood_list = F.coalesce(moods, F.array().cast("array<string>"))
    flags = [F.when(F.array_contains(mood_list, m), 1.0).otherwise(0.0) for m in VECTOR_MOODS]
    return F.array(
        clamp(safe_number(motion_score, 0.5)), clamp(safe_number(energy, 0.5)),
        *one_hot(F.coalesce(motion_type, F.lit("MEDIUM")), MOTIONS, 2), *flags,
        clamp(safe_number(camera)), clamp(safe_number(brightness_dynamics)), clamp(safe_number(color_dynamics)),
        *one_hot(F.coalesce(rhythm, F.lit("STEADY")), RHYTHMS, 0))


def uniform(key: Column, salt: str) -> Column:
    """Repeatable number in [0, 1) from a key, the same in any engine: the first 32 bits of a digest."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def imputed_vector(key: Column) -> Column:
    """Repeatable stand-in for a row without features: same layout, 2 to 5 moods."""
    motion = F.floor(uniform(key, "motion") * 5)
    count = F.floor(uniform(key, "moods") * 4) + 2
    draws = F.array_sort(F.array(*[F.struct(uniform(key, f"mood{i}").alias("u"), F.lit(i).alias("i")) for i in range(len(VECTOR_MOODS))]))
    chosen = F.transform(F.slice(draws, F.lit(1), count.cast("int")), lambda d: d["i"])
    rhythm = F.floor(uniform(key, "rhythm") * 3)
    return F.array(
        uniform(key, "a"), uniform(key, "b"), *[F.when(motion == i, 1.0).otherwise(0.0) for i in range(5)],
        *[F.when(F.array_contains(chosen, F.lit(i)), 1.0).otherwise(0.0) for i in range(len(VECTOR_MOODS))],
        uniform(key, "c"), uniform(key, "d"), uniform(key, "e"), *[F.when(rhythm == i, 1.0).otherwise(0.0) for i in range(3)])
