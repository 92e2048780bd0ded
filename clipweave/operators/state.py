"""State tables: lookups, versioned updates and merges that protect manual work.

Every function takes the current version of a table and returns the next one; the
caller writes it (a new path or table version), so a job can be run again safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.text import is_blank, strip
from clipweave.plans.overlap import overlap_join, overlap_ratio

AUTO_PREFIX = "说话人"  # fixed value: automatic speaker names start with it


# --- lookups ------------------------------------------------------------------

def items_of_project(items: DataFrame, project_id: object) -> DataFrame:
    return items.filter(F.col("project_id") == project_id).orderBy("created", "item_id")


def project_counts(projects: DataFrame, items: DataFrame, characters: DataFrame) -> DataFrame:
    """Projects with their number of items and characters; zero stays."""
    n_items = items.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_items"))
    n_chars = characters.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_characters"))
    return (
        projects.join(n_items, "project_id", "left").join(n_chars, "project_id", "left")
        .fillna(0, ["n_items", "n_characters"])
    )


def with_items(segments: DataFrame, items: DataFrame) -> DataFrame:
    """All segments of a project with their item."""
    return segments.join(items, "item_id")


def character_of_key(keys: DataFrame, characters: DataFrame) -> DataFrame:
    """First character (by ``ord``) that holds a label key."""
    owners = characters.select("ord", "char_id", F.explode("labels").alias("label_key")).groupBy("label_key").agg(
        F.min_by("char_id", "ord").alias("char_id")
    )
    return keys.join(owners, "label_key", "left")


def segments_of_character(segments: DataFrame, character: str | None) -> DataFrame:
    """Segments of one character; None selects the unassigned ones."""
    return segments.filter(F.col("character_id").eqNullSafe(F.lit(character)))


def orphan_characters(characters: DataFrame, segments: DataFrame, valid: DataFrame) -> DataFrame:
    """Characters that can never match again.

    They have labels, no trained model, no segment refers to them, and no label starts
    with one of the ``valid`` prefixes (column ``prefix``; item ids by default).
    """
    candidates = characters.filter((F.coalesce("exp", F.lit("")) == "") & (F.size("labels") > 0))
    used = segments.filter("character_id IS NOT NULL").select(F.col("character_id").alias("char_id"))
    alive = (
        candidates.select("char_id", F.explode("labels").alias("lb"))
        .withColumn("prefix", F.substring_index("lb", ":", 1))
        .join(valid.select(F.col("prefix").cast("string").alias("prefix")), "prefix", "left_semi")
        .select("char_id")
    )
    return candidates.join(used, "char_id", "left_anti").join(alive, "char_id", "left_anti")


def stale_characters(characters: DataFrame) -> DataFrame:
    """Automatic characters of one item (``item_id``) that nothing else uses."""
    n = F.coalesce(F.nullif(F.col("emb_count"), F.lit(0)), F.lit(1))
    own = F.concat(F.col("item_id").cast("string"), F.lit(":"))
    return characters.filter(
        (F.coalesce("exp", F.lit("")) == "") & (F.size("labels") > 0) & F.col("name").startswith(AUTO_PREFIX)
        & (n <= 1) & F.forall("labels", lambda lb: lb.startswith(own))
    )


def in_all(sets: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first table whose key is present in every other one."""
    out = sets[0]
    for other in sets[1:]:
        out = out.join(other.select(key), key, "left_semi")
    return out


def phoneme_ids(rows: DataFrame, vocabulary: DataFrame, unknown: str | None = "UNK") -> DataFrame:
    """Symbols to ids by position; unknown symbols become ``unknown`` or a null array.

    ``rows``: name, phones; ``vocabulary``: symbol, id.
    """
    flat = rows.select("name", F.posexplode("phones").alias("pos", "symbol"))
    found = flat.join(vocabulary, "symbol", "left")
    if unknown is not None:
        spare = vocabulary.filter(F.col("symbol") == unknown).agg(F.max("id")).scalar()
        found = found.withColumn("id", F.coalesce(F.col("id"), spare))
    ids = found.groupBy("name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"),
        F.count_if(F.col("id").isNull()).alias("n_unknown"),
    )
    return ids.withColumn("ids", F.when(F.col("n_unknown") == 0, F.col("ids")))


# --- versioned updates -----------------------------------------------------------

def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Columns that ``new`` leaves null keep their old value."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    have = set(new.columns)
    joined = o.join(new, key, "full_outer")
    return joined.select(
        key, *[(F.coalesce(F.col(c), F.col(f"_o_{c}")) if c in have else F.col(f"_o_{c}")).alias(c) for c in cols]
    )


def replace_by_id(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace whole rows; the last version of a repeated id wins."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*old.columns), "version").alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def delete_items(items: DataFrame, snapshots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove items together with their snapshots."""
    ids = gone.select("item_id")
    return items.join(ids, "item_id", "left_anti"), snapshots.join(ids, "item_id", "left_anti")


def deletable_projects(projects: DataFrame, items: DataFrame) -> DataFrame:
    """Only projects without items may be deleted."""
    return projects.join(items.select("project_id"), "project_id", "left_anti")


def assign_default_project(items: DataFrame, projects: DataFrame) -> DataFrame:
    """Items without a project move to the oldest one."""
    oldest = projects.agg(F.min_by("project_id", F.struct("created", "project_id"))).scalar()
    return items.withColumn("project_id", F.coalesce(F.col("project_id"), oldest))


def pool_item_characters(items: DataFrame) -> DataFrame:
    """Per-item characters to pool rows whose labels carry the item; no id, no row."""
    one = items.select("item_id", F.explode("characters").alias("c")).filter("c.id IS NOT NULL AND c.id <> ''")
    prefix = F.concat(F.col("item_id").cast("string"), F.lit(":"))
    return one.select(
        "item_id", F.col("c.id").alias("char_id"), F.col("c.name").alias("name"),
        F.transform("c.labels", lambda lb: F.concat(prefix, lb)).alias("labels"),
    )


def backfill(rows: DataFrame, source: DataFrame, key: str, columns: list[str], empty: str = "[]") -> DataFrame:
    """Fill columns that still hold the default; running it again changes nothing."""
    s = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(s, key, "left")
    filled = {
        c: F.when(F.coalesce(F.col(c), F.lit(empty)) == empty, F.coalesce(f"_s_{c}", F.lit(empty))).otherwise(F.col(c))
        for c in columns
    }
    return joined.withColumns(filled).drop(*[f"_s_{c}" for c in columns])


def detach_characters(segments: DataFrame, gone: DataFrame, drop_label: bool = False) -> DataFrame:
    """Unassign unlocked segments whose character is in ``gone`` (char_id)."""
    hit = gone.select(F.col("char_id").alias("character_id"), F.lit(True).alias("_hit")).distinct()
    off = ~F.col("locked") & F.coalesce("_hit", F.lit(False))
    out = segments.join(hit, "character_id", "left").withColumn("changed", off)
    cols = ["character_id", "speaker_label"] if drop_label else ["character_id"]
    return out.withColumns({c: F.when(~F.col("changed"), F.col(c)) for c in cols}).drop("_hit")


def reset_project(segments: DataFrame, characters: DataFrame, project: object) -> tuple[DataFrame, DataFrame]:
    """Drop the project's characters and every assignment, locked ones too.

    Text and the lock stay.
    """
    mine = F.col("project_id") == project
    cleared = segments.withColumn("changed", mine & F.col("character_id").isNotNull()).withColumn(
        "character_id", F.when(~mine, F.col("character_id"))
    )
    return cleared, characters.filter(~mine)


def merge_fields(fresh: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Copy only the owned fields onto the fresh table; vanished and new ids are left alone.

    A field is taken when the update has it (``has_<field>`` column, else not null).
    """
    u = updates.select(
        key,
        *[F.col(c).alias(f"_u_{c}") for c in fields],
        *[
            (F.col(f"has_{c}") if f"has_{c}" in updates.columns else F.col(c).isNotNull()).alias(f"_h_{c}")
            for c in fields
        ],
    )
    out = fresh.join(u, key, "left")
    out = out.withColumns(
        {c: F.when(F.coalesce(f"_h_{c}", F.lit(False)), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in fields}
    )
    return out.select(*fresh.columns)


def merge_locked(stored: DataFrame, incoming: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Write-back that keeps manual work: locked stored rows win.

    A locked row that is still present replaces the incoming one; a locked row that
    went missing comes back, and unlocked incoming rows that overlap it by at least
    ``ratio`` of the shorter one go.
    """
    cols = incoming.columns
    keep = stored.filter("locked AND seg_id IS NOT NULL").select(*cols)
    ids = keep.select("item_id", "seg_id")
    missing = keep.join(incoming.select("item_id", "seg_id"), ["item_id", "seg_id"], "left_anti")
    open_rows = incoming.join(ids, ["item_id", "seg_id"], "left_anti")
    spans = open_rows.filter("NOT locked").select("item_id", "seg_id", "start_ms", "end_ms")
    hit = overlap_join(spans, missing.select("item_id", "start_ms", "end_ms"), ["item_id"])
    covered = hit.filter(overlap_ratio("start_ms", "end_ms", "r_start_ms", "r_end_ms") >= ratio)
    rest = open_rows.join(covered.select("item_id", "seg_id"), ["item_id", "seg_id"], "left_anti")
    return rest.unionByName(keep)


def merge_characters(characters: DataFrame, segments: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge picked characters: ``picks`` has merge_id, char_id, pick_no, name.

    The first pick is the target and gets the new name and all labels in order.
    """
    joined = picks.join(characters.select("char_id", "labels"), "char_id")
    merged = joined.groupBy("merge_id").agg(
        F.min_by("char_id", "pick_no").alias("target"), F.first("name").alias("_name"),
        F.array_distinct(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("pick_no", "labels"))), lambda x: x["labels"]))).alias("_labels"),
        F.count(F.lit(1)).alias("_n"),
    ).filter("_n >= 2")
    moves = joined.join(merged.select("merge_id", "target"), "merge_id").select("char_id", "target")
    gone = moves.filter("char_id <> target")
    left = characters.join(gone.select("char_id"), "char_id", "left_anti")
    named = merged.select(F.col("target").alias("char_id"), "_name", "_labels")
    left = left.join(named, "char_id", "left").withColumns({
        "name": F.coalesce("_name", "name"), "labels": F.coalesce("_labels", "labels")}).drop("_name", "_labels")
    to = gone.select(F.col("char_id").alias("character_id"), "target")
    seg = segments.join(to, "character_id", "left").withColumn(
        "character_id", F.coalesce("target", "character_id")).drop("target")
    return left, seg


def delete_characters(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Segments of deleted characters become unassigned."""
    hit = gone.select(F.col("char_id").alias("character_id"), F.lit(True).alias("_hit")).distinct()
    return segments.join(hit, "character_id", "left").withColumn(
        "character_id", F.when(F.col("_hit").isNull(), F.col("character_id"))
    ).drop("_hit")


def merge_segments(rows: DataFrame) -> DataFrame:
    """Merge the rows of each ``merge_id`` (one item, at least two rows) into the first.

    Texts join in start order, with a space for English; the result is locked and its
    score is gone.
    """
    row = F.struct("start_ms", "ord", F.coalesce("text", F.lit("")).alias("text"), "language", "seg_id")
    grouped = rows.groupBy("merge_id").agg(
        F.sort_array(F.collect_list(row)).alias("_r"), F.min("item_id").alias("item_id"), F.max("item_id").alias("_i"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    ).filter((F.size("_r") >= 2) & (F.col("item_id") == F.col("_i")))
    texts = F.filter(F.transform("_r", lambda x: x["text"]), lambda t: t != "")
    first = F.col("_r")[0]
    return grouped.select(
        "merge_id", "item_id", first["seg_id"].alias("seg_id"), "start_ms", "end_ms",
        F.when(first["language"] == "EN", F.array_join(texts, " ")).otherwise(F.array_join(texts, "")).alias("text"),
        F.lit(None).cast("double").alias("q"), F.lit(True).alias("locked"), F.size("_r").alias("merged"),
    )


def merge_manifest_rows(lines: DataFrame, picks: DataFrame) -> DataFrame:
    """Concatenate the texts of picked manifest rows into the first; the others go."""
    chosen = lines.join(picks, "ord")
    texts = chosen.groupBy("merge_id").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("_t"),
    )
    later = chosen.join(texts.select("ord"), "ord", "left_anti").select("ord")
    return lines.join(later, "ord", "left_anti").join(texts.select("ord", "_t"), "ord", "left").withColumn(
        "text", F.coalesce("_t", "text")).drop("_t")


def toggle_lock(segments: DataFrame, picks: DataFrame, force: bool | None = None) -> DataFrame:
    """Per selection: lock all unless all are locked already (or as forced)."""
    keys = ["item_id", "seg_id"]
    chosen = picks.join(segments.select(*keys, "locked"), keys)
    target = F.lit(force) if force is not None else ~F.bool_and("locked")
    want = chosen.groupBy("selection").agg(target.alias("_to"))
    plan = picks.join(want, "selection").select(*keys, "_to")
    return segments.join(plan, keys, "left").withColumn("locked", F.coalesce("_to", "locked")).drop("_to")


def recover_deleted(snapshot: DataFrame, current: DataFrame, alarm: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows of a snapshot that vanished, put back at their place; and items that lost many.

    Current rows keep their order, a restored row goes before the current rows at or
    behind its old index, as inserting at that index does.
    """
    keys = ["item_id", "seg_id"]
    gone = snapshot.join(current.select(*keys), keys, "left_anti")
    losses = gone.groupBy("item_id").agg(F.count(F.lit(1)).alias("missing")).withColumn("alarm", F.col("missing") > alarm)
    return gone, losses


def restore_order(current: DataFrame, gone: DataFrame) -> DataFrame:
    """Current plus recovered rows with a new ``ord`` per item."""
    from clipweave.plans.scan import number_rows, plan_cells

    # inserting in index order: the r-th restored row lands at its old index, or at the
    # end when the list is shorter; current rows move behind the rows inserted before them
    back = number_rows(gone, ["item_id"], ["ord"], "_r").withColumn("_slot", F.col("ord") - (F.col("_r") - 1))
    now = number_rows(current, ["item_id"], ["ord"], "_n").withColumn("_slot", F.col("_n") - 1)
    both = now.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(0).cast("long")).drop("_n").unionByName(
        back.withColumn("_side", F.lit(0))
    )
    cells = plan_cells(both, ["item_id"], F.col("_slot"))
    out = number_rows(both, ["item_id"], ["_slot", "_side", "_r"], "_new", cells=cells)
    return out.withColumn("ord", F.col("_new") - 1).drop("_slot", "_side", "_r", "_new")


def lineage(items: DataFrame) -> DataFrame:
    """Root and depth of derived items (``derived_from``), by pointer doubling.

    After step k every row knows its ancestor 2^k levels up, so the number of joins is
    the logarithm of the longest chain. Cycles end after log2(rows) steps.
    """
    from clipweave.session import cut

    hop = items.select("item_id", F.coalesce("derived_from", "item_id").alias("root"),
                       F.col("derived_from").isNotNull().cast("int").alias("depth"))
    derived = items.filter("derived_from IS NOT NULL").select(F.col("item_id").alias("root"))
    for _ in range(items.count().bit_length()):
        if hop.join(derived, "root", "left_semi").limit(1).count() == 0:
            break
        up = hop.select(F.col("item_id").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_d"))
        hop = cut(hop.join(up, "root", "left").select(
            "item_id", F.coalesce("_next", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")
        ))
    return hop


def inherit_project(items: DataFrame) -> DataFrame:
    """Derived items take the project of their parent."""
    parent = items.select(F.col("item_id").alias("derived_from"), F.col("project_id").alias("_p"))
    return items.join(parent, "derived_from", "left").withColumn("project_id", F.coalesce("_p", "project_id")).drop("_p")


def reassign(segments: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set characters by hand: the rows get locked, and each non-null one is a sample.

    ``picks``: item_id, seg_id, new_character (blank = unassign).
    """
    keys = ["item_id", "seg_id"]
    p = picks.select(*keys, F.nullif(F.col("new_character"), F.lit("")).alias("_c"), F.lit(True).alias("_hit"))
    joined = segments.join(p, keys, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    out = joined.withColumns({
        "character_id": F.when(F.col("_hit"), F.col("_c")).otherwise(F.col("character_id")),
        "locked": F.col("locked") | F.col("_hit"),
    })
    samples = out.filter("_hit AND _c IS NOT NULL").select(*keys, "character_id", "start_ms", "end_ms")
    return out.drop("_c", "_hit"), samples


def apply_bounds(segments: DataFrame, items: DataFrame, edits: DataFrame) -> DataFrame:
    """New bounds, clamped to the item; adds ``edit`` = applied | too short | unchanged | null.

    Applied edits are the re-transcription requests.
    """
    keys = ["item_id", "seg_id"]
    e = edits.select(*keys, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    joined = segments.join(e, keys, "left").join(items.select("item_id", "duration_ms"), "item_id", "left")
    clamp = lambda c: F.when(F.col("duration_ms") > 0, F.greatest(F.lit(0), F.least(c, F.col("duration_ms")))).otherwise(c)
    joined = joined.withColumns({"_s": clamp(F.col("_s")), "_e": clamp(F.col("_e"))})
    same = (F.abs(F.col("_s") - F.col("start_ms")) < 5) & (F.abs(F.col("_e") - F.col("end_ms")) < 5)
    edit = (
        F.when(F.col("_s").isNull(), None).when(F.col("_e") - F.col("_s") < 10, "too short").when(same, "unchanged").otherwise("applied")
    )
    done = F.col("edit") == "applied"
    return joined.withColumn("edit", edit).withColumns({
        "start_ms": F.when(done, F.col("_s")).otherwise(F.col("start_ms")),
        "end_ms": F.when(done, F.col("_e")).otherwise(F.col("end_ms")),
    }).drop("_s", "_e", "duration_ms")


def fill_texts(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Write new non-blank texts by segment id; unknown ids are ignored."""
    keys = ["item_id", "seg_id"]
    t = texts.select(*keys, strip(F.col("text")).alias("_t"))
    return segments.join(t, keys, "left").withColumn(
        "text", F.when(~is_blank(F.col("_t")), F.col("_t")).otherwise(F.col("text"))).drop("_t")


def live_over_history(history: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Union by id in which the live row wins."""
    return history.join(live.select(key), key, "left_anti").unionByName(live)


def alive(rows: DataFrame, now: Column, finished: str = "finished", ttl_seconds: int = 3600,
          terminal: tuple[str, ...] = ("done", "error", "cancelled")) -> DataFrame:
    """Rows not yet expired: only finished rows in a terminal state can expire."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(finished))
    dead = F.col("status").isin(*terminal) & F.col(finished).isNotNull() & (age > ttl_seconds)
    return rows.filter(~F.coalesce(dead, F.lit(False)))


def dependency_state(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Is a task ready? ``deps``: task_id, upstream, place; ``tasks``: task_id, status, result.

    Any failed or missing upstream is an error at once; all done means ready, with the
    results in declared order.
    """
    up = tasks.select(F.col("task_id").alias("upstream"), F.col("status").alias("_s"), F.col("result").alias("_r"))
    # partial aggregation first: an order with very many upstreams is no hot group
    joined = deps.join(up, "upstream", "left")
    bad = F.col("_s").isNull() | F.col("_s").isin("error", "cancelled", "interrupted")
    return joined.groupBy("task_id").agg(
        F.when(F.bool_or(bad), "error").when(F.bool_and(F.col("_s") == "done"), "ready").otherwise("waiting").alias("state"),
        F.count_if(F.coalesce(F.col("_s") == "done", F.lit(False))).alias("n_done"),
        F.count(F.lit(1)).alias("n_upstream"),
    )


def ordered_results(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """One row per upstream of the ready tasks, with its result and declared place."""
    ready = dependency_state(tasks, deps).filter("state = 'ready'").select("task_id")
    up = tasks.select(F.col("task_id").alias("upstream"), "result")
    return deps.join(ready, "task_id", "left_semi").join(up, "upstream").select("task_id", "place", "upstream", "result")


def cascade_failures(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks downstream of a failed one fail too, level by level.

    Each round visits only tasks next to the newest failures; it ends when none is new,
    also with cyclic dependencies.
    """
    from clipweave.session import cut

    state = tasks.select("task_id", "status")
    failed = state.filter(F.col("status").isin("error", "cancelled", "interrupted")).select("task_id")
    known = deps.join(state.select(F.col("task_id").alias("upstream")), "upstream", "left_anti").select("task_id")
    newest = dead = cut(failed.unionByName(known).distinct())
    pending = state.filter("status = 'pending'").select("task_id")
    while newest.limit(1).count():
        hit = deps.join(newest.select(F.col("task_id").alias("upstream")), "upstream", "left_semi").select("task_id").distinct()
        newest = cut(hit.join(pending, "task_id", "left_semi").join(dead, "task_id", "left_anti"))
        dead = cut(dead.unionByName(newest))
    mark = dead.withColumn("_f", F.lit(True))
    return tasks.join(mark, "task_id", "left").withColumn(
        "status", F.when(F.col("_f") & (F.col("status") == "pending"), "error").otherwise(F.col("status"))).drop("_f")
