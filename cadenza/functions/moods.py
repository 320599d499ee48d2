"""Mood, motion and emotion vocabularies, and their mappings as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: motion classes in rising order
MOTIONS = ["STATIC", "SLOW", "MEDIUM", "FAST", "EXTREME"]
# fixed values: moods with (valence, arousal)
MOOD_EMOTIONS = {
    "CALM": (0.2, -0.6), "PEACEFUL": (0.5, -0.5), "CHEERFUL": (0.7, 0.3), "ENERGETIC": (0.5, 0.7),
    "MELANCHOLIC": (-0.6, -0.4), "EUPHORIC": (0.8, 0.9), "AGGRESSIVE": (-0.5, 0.8), "MYSTERIOUS": (-0.2, -0.3),
    "DREAMY": (0.3, -0.4), "COOL": (0.1, 0.2), "WARM": (0.6, 0.1), "NOSTALGIC": (0.2, -0.3), "ROMANTIC": (0.7, 0.0),
    "TENSE": (-0.4, 0.5), "PLAYFUL": (0.6, 0.5),
}
MOODS = list(MOOD_EMOTIONS)
# fixed values: palette per mood as (primary L, a, b), temperature, brightness, saturation
PALETTES = {
    "CALM": ((70, -5, -10), "COOL", "MEDIUM", 0.3), "PEACEFUL": ((80, -10, 10), "NEUTRAL", "BRIGHT", 0.4),
    "CHEERFUL": ((85, 10, 50), "WARM", "BRIGHT", 0.7), "ENERGETIC": ((60, 50, 30), "WARM", "MEDIUM", 0.8),
    "MELANCHOLIC": ((40, 0, -20), "COOL", "DARK", 0.4), "EUPHORIC": ((70, 40, -30), "WARM", "BRIGHT", 0.9),
    "AGGRESSIVE": ((45, 60, 40), "WARM", "DARK", 0.9), "MYSTERIOUS": ((30, 10, -30), "COOL", "DARK", 0.5),
    "DREAMY": ((75, 20, -20), "COOL", "BRIGHT", 0.5), "COOL": ((55, -10, -25), "COOL", "MEDIUM", 0.6),
    "WARM": ((65, 20, 40), "WARM", "MEDIUM", 0.6), "NOSTALGIC": ((55, 10, 20), "WARM", "MEDIUM", 0.4),
    "ROMANTIC": ((65, 35, -10), "WARM", "MEDIUM", 0.6), "TENSE": ((35, 20, -10), "NEUTRAL", "DARK", 0.5),
    "PLAYFUL": ((75, 30, 60), "WARM", "BRIGHT", 0.8),
}
# fixed values: (valence, arousal) per segment type
SEGMENT_EMOTIONS = {
    "intro": (0.0, -0.3), "verse": (0.2, 0.0), "chorus": (0.6, 0.5), "drop": (0.5, 0.9), "bridge": (-0.1, -0.2),
    "outro": (0.1, -0.4), "buildup": (0.3, 0.6), "breakdown": (-0.2, -0.5),
}
# fixed values: target moods and motions per segment type
SEGMENT_MOODS = {
    "intro": ["CALM", "PEACEFUL", "DREAMY", "MYSTERIOUS"], "verse": ["CALM", "PEACEFUL", "MELANCHOLIC", "COOL"],
    "chorus": ["ENERGETIC", "CHEERFUL", "BRIGHT", "WARM", "EUPHORIC"], "drop": ["ENERGETIC", "EUPHORIC", "AGGRESSIVE", "TENSE"],
    "bridge": ["DREAMY", "MYSTERIOUS", "MELANCHOLIC", "COOL"], "outro": ["CALM", "PEACEFUL", "DREAMY", "WARM"],
}
SEGMENT_MOTIONS = {
    "intro": ["STATIC", "SLOW"], "verse": ["SLOW", "MEDIUM"], "chorus": ["FAST", "EXTREME"], "drop": ["EXTREME"],
    "bridge": ["MEDIUM", "SLOW"], "outro": ["SLOW", "STATIC"],
}
# fixed values: moods a palette may take per segment type
PALETTE_MOODS = {
    "intro": ["CALM", "PEACEFUL", "DREAMY", "MYSTERIOUS"],
    "verse": ["CALM", "PEACEFUL", "MELANCHOLIC", "COOL"],
    "drop": ["ENERGETIC", "EUPHORIC", "AGGRESSIVE", "TENSE"],
    "bridge": ["DREAMY", "MYSTERIOUS", "MELANCHOLIC", "COOL"],
    "outro": ["CALM", "PEACEFUL", "DREAMY", "WARM"],
    "chorus": ["ENERGETIC", "CHEERFUL", "WARM", "EUPHORIC"],
    "buildup": ["TENSE", "ENERGETIC", "MYSTERIOUS"],
    "breakdown": ["CALM", "DREAMY", "MELANCHOLIC"],
}
# fixed values: moods that go with a target mood
COMPATIBLE = {
    "ENERGETIC": ["EUPHORIC", "AGGRESSIVE", "CHEERFUL", "TENSE"], "CALM": ["PEACEFUL", "DREAMY", "MELANCHOLIC"],
    "DARK": ["MYSTERIOUS", "TENSE", "MELANCHOLIC", "AGGRESSIVE"], "BRIGHT": ["CHEERFUL", "EUPHORIC", "PEACEFUL"],
    "MELANCHOLIC": ["CALM", "DARK", "DREAMY", "MYSTERIOUS"], "EUPHORIC": ["ENERGETIC", "CHEERFUL", "BRIGHT"],
    "AGGRESSIVE": ["ENERGETIC", "TENSE", "DARK"], "PEACEFUL": ["CALM", "DREAMY", "BRIGHT"],
    "MYSTERIOUS": ["DARK", "MELANCHOLIC", "TENSE"], "CHEERFUL": ["BRIGHT", "EUPHORIC", "ENERGETIC"],
    "TENSE": ["DARK", "AGGRESSIVE", "MYSTERIOUS", "ENERGETIC"], "DREAMY": ["CALM", "PEACEFUL", "MELANCHOLIC"],
    "COOL": ["CALM", "MYSTERIOUS", "MELANCHOLIC"], "WARM": ["CHEERFUL", "ENERGETIC", "BRIGHT"],
}
# fixed values: moods cycled per energy fifth
ENERGY_MOODS = [
    ["CALM", "DREAMY", "PEACEFUL"], ["PEACEFUL", "COOL", "MELANCHOLIC"], ["CHEERFUL", "WARM", "BRIGHT"],
    ["ENERGETIC", "EUPHORIC", "CHEERFUL"], ["ENERGETIC", "EUPHORIC", "AGGRESSIVE"],
]


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def words(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def pick(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of a small fixed table by key."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def pick_words(key: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Word list of a small fixed table by key, null where absent."""
    out = F.lit(None).cast("array<string>")
    for name, value in table.items():
        out = F.when(key == name, words(value)).otherwise(out)
    return out


def segment_valence(kind: Column) -> Column:
    return pick(kind, {k: v[0] for k, v in SEGMENT_EMOTIONS.items()}, 0.0)


def segment_arousal(kind: Column) -> Column:
    return pick(kind, {k: v[1] for k, v in SEGMENT_EMOTIONS.items()}, 0.0)


def mood_point(mood: Column) -> Column:
    """struct(v, a) of a mood, null for unknown moods."""
    v = pick(mood, {k: p[0] for k, p in MOOD_EMOTIONS.items()})
    a = pick(mood, {k: p[1] for k, p in MOOD_EMOTIONS.items()})
    return F.when(v.isNotNull(), F.struct(v.alias("v"), a.alias("a")))


def audio_emotion(energy: Column, brightness: Column, richness: Column, percussiveness: Column,
                  mode: Column | None = None) -> tuple[Column, Column]:
    """(valence, arousal) from audio features, each in [-1, 1]."""
    valence = (brightness * 0.4 + richness * 0.3 - 0.35) * 2
    if mode is not None:
        valence = F.when(mode == "major", F.least(F.lit(1.0), valence + 0.2)).when(
            mode == "minor", F.greatest(F.lit(-1.0), valence - 0.2)).otherwise(valence)
    arousal = (energy * 0.5 + percussiveness * 0.5 - 0.25) * 2
    return clamp(valence, -1.0, 1.0), clamp(arousal, -1.0, 1.0)


def motion_for_energy(energy: Column, limits: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> Column:
    out = F.lit(MOTIONS[-1])
    for name, limit in reversed(list(zip(MOTIONS, limits))):
        out = F.when(energy < limit, name).otherwise(out)
    return out


def cycled_mood(energy: Column, index: Column) -> Column:
    """Mood by energy fifth, cycling through three with the cut index."""
    lists = words(ENERGY_MOODS[-1])
    for limit, items in reversed(list(zip((0.2, 0.4, 0.6, 0.8), ENERGY_MOODS))):
        lists = F.when(energy < limit, words(items)).otherwise(lists)
    return F.element_at(lists, (F.pmod(index, F.lit(3)) + 1).cast("int"))


def plain_mood(energy: Column) -> Column:
    return F.when(energy < 0.3, "CALM").when(energy < 0.45, "PEACEFUL").when(energy < 0.6, "CHEERFUL").otherwise("ENERGETIC")


def quadrant_mood(valence: Column, arousal: Column) -> Column:
    """Mood class of a point in the (valence, arousal) plane."""
    return (
        F.when((arousal >= 0) & (valence >= 0) & (arousal > 0.7), "EUPHORIC")
        .when((arousal >= 0) & (valence >= 0) & (arousal > 0.4), "ENERGETIC")
        .when((arousal >= 0) & (valence >= 0), "CHEERFUL")
        .when((arousal >= 0) & (arousal > 0.7), "AGGRESSIVE").when(arousal >= 0, "TENSE")
        .when((valence >= 0) & (valence > 0.5), "PEACEFUL").when(valence >= 0, "CALM")
        .when(arousal < -0.5, "MELANCHOLIC").otherwise("MYSTERIOUS"))
