"""Catalog of clips: scans, filters, sorting, availability, duplicates, tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import Running, running

# fixed values: media file endings
VIDEO_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".webm", ".m4v"]


def json_list(col: Column, item: str = "string") -> Column:
    """JSON array text as an array; bad or missing text becomes empty."""
    empty = F.array().cast(f"array<{item}>")
    return F.coalesce(F.from_json(col, f"array<{item}>"), empty)


def json_map(col: Column, value: str = "double") -> Column:
    """JSON object text as a map; bad or missing text becomes empty."""
    return F.coalesce(F.from_json(col, f"map<string,{value}>"), F.create_map().cast(f"map<string,{value}>"))


def latest_per_clip(side: DataFrame, when: str = "analyzed_at", clip_id: str = "clip_id") -> DataFrame:
    """One row per clip: the latest, so that joins never multiply clips."""
    rest = [c for c in side.columns if c != clip_id]
    return side.groupBy(clip_id).agg(F.max_by(F.struct(*rest), F.col(when)).alias("_r")).select(clip_id, "_r.*")


def with_families(clips: DataFrame, families: Mapping[str, DataFrame], clip_id: str = "clip_id", needed: Sequence[str] = ()) -> DataFrame:
    """Clips with one struct per side table, null where the clip has no row.

    Clips without a row in one of the `needed` families are left out by an
    inner join.
    """
    out = clips
    for name, side in families.items():
        cols = [c for c in side.columns if c != clip_id]
        out = out.join(side.select(clip_id, F.struct(*cols).alias(name)), clip_id, "inner" if name in needed else "left")
    return out


# fixed values: the family that each filter or facet reads
FILTER_FAMILIES = {
    "motion_type": "motion", "camera_motion": "motion", "mood": "mood", "energy_range": "mood", "scene_type": "scene", "has_face": "scene",
    "style": "style", "temperature": "color", "brightness_range": "color", "brightness": "color", "is_analyzed": "status",
}


def _is_set(name: str, value: object) -> bool:
    return not (value is None or value == [] or value == "" or value == "All" or (name.endswith("_range") and tuple(value) == (None, None)))


def filtered_families(clips: DataFrame, families: Mapping[str, DataFrame], filters: Mapping[str, object], clip_id: str = "clip_id") -> DataFrame:
    """Clips with the families that set `filters` (or facets) read, and no others.

    A filter on a family asks for a row there, so the join is inner; only
    is_analyzed = False also takes clips without a status.
    """
    used = {FILTER_FAMILIES[n]: n for n, value in filters.items() if n in FILTER_FAMILIES and _is_set(n, value)}
    needed = [f for f in used if not (f == "status" and not filters["is_analyzed"])]
    return with_families(clips, {f: families[f] for f in families if f in used}, clip_id, needed)


def _any_of(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def clip_filter(filters: Mapping[str, object], required: Sequence[str] = ()) -> Column:
    """One predicate over a table of `with_families`; unset filters are ignored.

    Keys: motion_type, mood, scene_type, style, temperature (value or list),
    duration_range, brightness_range, energy_range (low, high), has_face,
    is_analyzed. `required` names the status flags of an analysed clip.
    """
    p = F.lit(True)
    lists = {"mood": "mood.moods", "scene_type": "scene.scene_types", "style": "style.styles"}
    ranges = {"duration_range": "duration", "brightness_range": "color.brightness_value", "energy_range": "mood.energy"}
    for name, value in filters.items():
        if value is None or value == [] or value == "":
            continue
        if name == "motion_type":
            p = p & F.col("motion.motion_type").isin(_any_of(value))
        elif name == "temperature":
            p = p & F.col("color.temperature").isin(_any_of(value))
        elif name in lists:
            p = p & F.arrays_overlap(F.col(lists[name]), F.array(*[F.lit(x) for x in _any_of(value)]))
        elif name in ranges:
            low, high = value
            if low is not None:
                p = p & (F.col(ranges[name]) >= low)
            if high is not None:
                p = p & (F.col(ranges[name]) <= high)
        elif name == "has_face":
            p = p & (F.col("scene.has_face") == value)
        elif name == "is_analyzed":
            done = F.lit(True)
            for flag in required:
                done = done & F.coalesce(F.col(f"status.{flag}"), F.lit(False))
            p = p & (done if value else ~done)
        else:
            raise ValueError(f"unknown filter {name!r}")
    return F.coalesce(p, F.lit(False))


# fixed values: facet name to the column it compares
FACETS = {"motion_type": "motion.motion_type", "camera_motion": "motion.camera_motion", "brightness": "color.brightness"}
LIST_FACETS = {"mood": "mood.moods", "style": "style.styles", "scene_type": "scene.scene_types"}


def facet_filter(facets: Mapping[str, str]) -> Column:
    """Equality per facet; `All` matches everything, a missing family nothing."""
    p = F.lit(True)
    for name, value in facets.items():
        if value == "All":
            continue
        if name in LIST_FACETS:
            p = p & F.coalesce(F.array_contains(F.col(LIST_FACETS[name]), value), F.lit(False))
        elif name in FACETS:
            p = p & F.coalesce(F.col(FACETS[name]) == value, F.lit(False))
    return p


def name_search(term: str, name: Column | None = None) -> Column:
    name = F.col("name") if name is None else name
    return F.lower(F.coalesce(name, F.lit(""))).contains(term.lower()) if term else F.lit(True)


def technical_search(term: str) -> Column:
    """Search in file name, codec and frame size."""
    text = F.concat_ws(" ", F.regexp_extract("file_path", r"[^/]*$", 0), F.coalesce("codec", F.lit("")),
                       F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))
    return F.lower(text).contains(term.lower()) if term else F.lit(True)


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order; with a limit that many, after `offset` rows."""
    out = df.orderBy(*order)
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def library_order(by: str) -> list[Column]:
    """Sort columns of the library views; numbers descend, ids break ties."""
    keys = {
        "duration": F.coalesce("duration", F.lit(0.0)).desc(), "motion": F.coalesce("motion.motion_score", F.lit(0.0)).desc(),
        "brightness": F.coalesce("color.brightness_value", F.lit(128.0)).desc(), "date": F.col("created_at").asc_nulls_first(),
    }
    return [keys.get(by, F.lower(F.coalesce("name", F.lit(""))).asc()), F.col("clip_id").asc()]


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the given ids, and children whose parent is left."""
    left = parents.join(gone.select(key).distinct(), key, "left_anti")
    return left, {name: df.join(left.select(key), key, "left_semi") for name, df in children.items()}


def new_content(listing: DataFrame, catalog: DataFrame, fingerprint: str = "content_fingerprint") -> DataFrame:
    """Listed rows whose fingerprint is not in the catalog; rows without one are left out."""
    known = catalog.filter(F.col(fingerprint).isNotNull()).select(fingerprint).distinct()
    return listing.filter(F.col(fingerprint).isNotNull()).join(known, fingerprint, "left_anti")


def exact_duplicates(listing: DataFrame, catalog: DataFrame, fingerprint: str = "content_fingerprint", item_id: str = "clip_id") -> DataFrame:
    """Listed rows with the lowest catalog id of equal content."""
    first = catalog.groupBy(fingerprint).agg(F.min(item_id).alias("match_id"))
    return listing.join(first, fingerprint)


def duplicate_groups(catalog: DataFrame, fingerprint: str = "content_fingerprint", item_id: str = "clip_id") -> DataFrame:
    """(id, fingerprint, group_id, group_size) of clips with equal content.

    Members stay rows: a group may hold a large part of the catalog.
    """
    known = catalog.filter(F.col(fingerprint).isNotNull())
    groups = known.groupBy(fingerprint).agg(F.min(item_id).alias("group_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return known.select(item_id, fingerprint).join(groups, fingerprint)


def folder(path: Column) -> Column:
    """Parent folder of a path."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(up == "", "/").otherwise(up)


def by_folder(clips: DataFrame, path: str = "file_path", item_id: str = "clip_id") -> DataFrame:
    """(folder, id, n_in_folder) of available clips."""
    placed = clips.filter("is_available").filter(F.col(path).isNotNull() & (F.col(path) != "")).select(folder(F.col(path)).alias("folder"), item_id)
    return placed.join(placed.groupBy("folder").agg(F.count(F.lit(1)).alias("n_in_folder")), "folder")


def relocate(catalog: DataFrame, listing: DataFrame, roots: Sequence[str] = (), item_id: str = "clip_id") -> DataFrame:
    """(id, old_path, new_path, status): present, relocated or missing.

    A missing path is looked up by fingerprint: files in the original folder
    first, then by the order of `roots`, then by path.
    """
    paths = listing.select(F.col("file_path").alias("_seen")).distinct()
    checked = catalog.join(paths, F.col("file_path") == F.col("_seen"), "left")
    here = checked.filter(F.col("_seen").isNotNull()).select(item_id, F.col("file_path").alias("old_path"), F.col("file_path").alias("new_path"), F.lit("present").alias("status"))
    lost = checked.filter(F.col("_seen").isNull())
    files = listing.filter(F.col("content_fingerprint").isNotNull())
    root = F.lit(len(roots))
    for i, r in reversed(list(enumerate(roots))):
        root = F.when(F.col("file_path").startswith(r), i).otherwise(root)
    place = F.struct(root.alias("r"), F.col("file_path").alias("p"))
    # best copy per content and per (content, folder): one row each, however many copies there are
    anywhere = files.groupBy("content_fingerprint").agg(F.min(place).alias("_any"))
    same = files.withColumn("_dir", folder(F.col("file_path"))).groupBy("content_fingerprint", "_dir").agg(F.min("file_path").alias("_same"))
    origin = folder(F.coalesce("original_path", "file_path") if "original_path" in catalog.columns else F.col("file_path"))
    found = lost.withColumn("_dir", origin).join(same, ["content_fingerprint", "_dir"], "left").join(anywhere, "content_fingerprint", "left")
    target = F.coalesce(F.col("_same"), F.col("_any")["p"])
    moved = found.select(item_id, F.col("file_path").alias("old_path"), target.alias("new_path"),
                         F.when(target.isNotNull(), "relocated").otherwise("missing").alias("status"))
    return here.unionByName(moved)


def relocation_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "missing").alias("available"),
                     F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "relocated").alias("relocated"))


def apply_availability(catalog: DataFrame, found: DataFrame, seen_at: Column, item_id: str = "clip_id") -> DataFrame:
    """Catalog with paths, availability and last sight from `relocate`."""
    state = found.select(item_id, "new_path", "status")
    joined = catalog.join(state, item_id, "left")
    there = F.col("status").isin("present", "relocated")
    out = joined.withColumns({
        "original_path": F.coalesce(F.col("original_path") if "original_path" in catalog.columns else F.lit(None).cast("string"), F.col("file_path")),
        "file_path": F.coalesce("new_path", "file_path"),
        "is_available": F.when(F.col("status").isNull(), F.col("is_available")).otherwise(there),
        "last_seen_at": F.when(there, seen_at).otherwise(F.col("last_seen_at") if "last_seen_at" in catalog.columns else F.lit(None).cast("timestamp"))})
    return out.drop("new_path", "status")


def tags_of(clips: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """(clip_id, tag) pairs; deleted tags vanish with the inner join."""
    return clips.select("clip_id").join(bridge, "clip_id").join(tags.select("tag").distinct(), "tag").select("clip_id", "tag")


def edit_tags(bridge: DataFrame, assign: DataFrame | None = None, remove: DataFrame | None = None, deleted: DataFrame | None = None,
              tags: DataFrame | None = None) -> DataFrame:
    """Bridge after assignments (existing tags only), removals and deleted tags."""
    out = bridge.select("clip_id", "tag")
    if assign is not None:
        fresh = assign.select("clip_id", "tag")
        out = out.unionByName(fresh.join(tags.select("tag"), "tag", "left_semi").select("clip_id", "tag") if tags is not None else fresh).distinct()
    if remove is not None:
        out = out.join(remove, ["clip_id", "tag"], "left_anti")
    if deleted is not None:
        out = out.join(deleted.select("tag"), "tag", "left_anti")
    return out.select("clip_id", "tag")


def expired(inventory: DataFrame, now: Column, max_age_seconds: float = 7 * 86_400, modified: str = "modified_at") -> DataFrame:
    """Inventory rows older than the limit."""
    return inventory.filter(now.cast("double") - F.col(modified).cast("double") > max_age_seconds)


def over_budget(inventory: DataFrame, max_bytes: float, keys: Sequence[str] = (), modified: str = "modified", size: str = "size_bytes",
                item_id: str = "path", width: float | None = None) -> DataFrame:
    """Rows to evict, oldest first, until each group is within its size."""
    keys = list(keys) or ["_all"]
    rows = inventory.withColumn("_all", F.lit(1)).withColumn("_age", -F.col(modified).cast("double"))
    out = running(rows, keys, ["_age", item_id], [Running("_total", "sum", F.col(size), inclusive=True)], width)
    return out.filter(F.col("_total") > max_bytes).drop("_all", "_age", "_total")


def upsert_by_path(catalog: DataFrame, incoming: DataFrame, path: str = "file_path") -> DataFrame:
    """Catalog plus the incoming rows whose path is new."""
    return catalog.unionByName(incoming.join(catalog.select(path), path, "left_anti"), allowMissingColumns=True)


def replace_by_key(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows without the keys of `fresh`, plus `fresh`."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def accept_with_parent(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): rows with and without an existing parent."""
    known = parents.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti").withColumn("reason", F.lit(f"unknown {key}"))


def update_fields(table: DataFrame, changes: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """Table with the non-null columns of `changes`; `modified_at` moves where a row changed."""
    fields = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit")), key, "left")
    out = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields})
    if now is not None and "modified_at" in table.columns:
        out = out.withColumn("modified_at", F.when(F.col("_hit"), now).otherwise(F.col("modified_at")))
    return out.select(*table.columns)


def cache_key(*parts: Column, algorithm: str = "sha256") -> Column:
    """Hash over parts, for reuse of stored results."""
    text = F.concat_ws("_", *[p.cast("string") for p in parts])
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def segment_cache_key(path: Column, start: Column, duration: Column, settings: Sequence[Column]) -> Column:
    return F.md5(F.concat(path, F.format_string("%.3f_%.3f", start, duration), F.concat_ws("_", *settings)))


def bounded_segment(start: Column, duration: Column, available: Column, minimum: float = 0.1) -> Column:
    """Duration cut to what the clip has; null when less than `minimum` is left."""
    left = F.greatest(F.lit(0.0), available - start)
    short = F.when(left >= minimum, left)
    return F.when(available <= 0, F.lit(None).cast("double")).when(start + duration > available, short).otherwise(duration)
