"""Reviewers' decisions on duplicate groups, and the cumulative cleaned registry.

Tables: ``members (parent_id, id, decision, confidence, detection_types)``,
``groups (parent_id, ord, name, ...)``, ``store (key, decision, updated_at)`` with the
symmetric pair key, ``cleaned (list_id, ...)``, ``replaces (parent_id, id)``.
States are not changed in place: each function returns the new state.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.text import pair_key
from .grouping import against_parent


def set_decisions(members: DataFrame, updates: DataFrame) -> DataFrame:
    """Members with newer decisions from ``updates (parent_id, id, decision)``; a set decision is no longer carried."""
    new = updates.select("parent_id", "id", F.col("decision").alias("_new"))
    out = members.join(new, ["parent_id", "id"], "left").withColumn("decision", F.coalesce("_new", "decision"))
    if "decision_carried" in members.columns:
        out = out.withColumn("decision_carried", F.col("decision_carried") & F.col("_new").isNull())
    return out.select(members.columns)


def criterion(name: str) -> Column:
    """Which members a bulk action touches."""
    exact = F.array_contains("detection_types", "exact")
    known = {
        "all": F.lit(True),
        "exact": exact,
        "high-confidence": F.col("confidence") >= 0.95,
        "approved_exact": exact & (F.col("decision") == "pending"),
        "rejected_all": F.lit(True),
        "pending_all": F.lit(True),
    }
    return F.coalesce(known[name], F.lit(False))


def bulk_decisions(members: DataFrame, name: str, action: str) -> DataFrame:
    return members.withColumn("decision", F.when(criterion(name), action).otherwise(F.col("decision")))


def group_decisions(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Per group: approved, rejected, pending (all others) and total; zeros for groups without members."""
    counts = members.groupBy("parent_id").agg(F.count_if(F.col("decision") == "approve").alias("approved"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.count("*").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return groups.select("parent_id").join(counts, "parent_id", "left").select(
        "parent_id", zero("approved").alias("approved"), zero("rejected").alias("rejected"), (zero("total") - zero("approved") - zero("rejected")).alias("pending"), zero("total").alias("total")
    )


def registry_stats(groups: DataFrame, members: DataFrame) -> DataFrame:
    return group_decisions(groups, members).agg(F.count("*").alias("n_lists"), F.sum("total").alias("n_duplicates"), F.sum("approved").alias("approved"), F.sum("rejected").alias("rejected"), F.sum("pending").alias("pending"))


def stats_by_type(members: DataFrame) -> DataFrame:
    return members.select(F.explode("detection_types").alias("detection_type")).groupBy("detection_type").agg(F.count("*").alias("n"))


def _browsed(groups: DataFrame, members: DataFrame, decision: str | list[str] | None, search: str) -> DataFrame:
    """Groups with ``n_duplicates`` that a filter by decisions (of any of their members) and text leaves.

    Text is looked for in names; a group without a name has the start of its id, a member
    without one (or a table of members without names) its id.
    """
    wanted = [decision] if isinstance(decision, str) else decision
    some = bool(wanted) and set(wanted) != {"approve", "reject", "pending"}
    named = lambda df, short: F.lower(F.coalesce(F.nullif(F.col("name"), F.lit("")), short) if "name" in df.columns else short)
    has = lambda text: F.contains(text, F.lit(search.lower()))
    found = members.groupBy("parent_id").agg(
        F.count("*").alias("n_duplicates"), F.max(F.col("decision").isin(wanted) if some else F.lit(True)).alias("decided"), F.max(has(named(members, F.col("id").cast("string")))).alias("hit")
    )
    rows = groups.join(found, "parent_id", "left").withColumn("n_duplicates", F.coalesce("n_duplicates", F.lit(0).cast("long")))
    if some:
        rows = rows.where(F.coalesce("decided", F.lit(False)))
    if search:
        rows = rows.where(has(named(groups, F.substring(F.col("parent_id").cast("string"), 1, 10))) | F.coalesce("hit", F.lit(False)))
    return rows


def browse(groups: DataFrame, members: DataFrame, decision: str | list[str] | None = None, search: str = "", by: str = "duplicates", page: int = 1, per_page: int = 20) -> DataFrame:
    """A page of groups, filtered and sorted: ``parent_id, name, ord, n_duplicates`` and, if groups have ``vars``, how many there are and the first five."""
    rows = _browsed(groups, members, decision, search)
    order = [F.desc("n_duplicates"), "ord"] if by == "duplicates" else [F.lower("name"), "ord"]
    shown = [F.size("vars").alias("n_vars"), F.slice("vars", 1, 5).alias("vars")] if "vars" in groups.columns else []
    # Only the pages up to this one are sorted out, not the whole table.
    top = rows.select("parent_id", "name", "ord", "n_duplicates", *shown).orderBy(*order).limit(page * per_page)
    return top.offset((page - 1) * per_page)


def browse_total(groups: DataFrame, members: DataFrame, decision: str | list[str] | None = None, search: str = "", per_page: int = 20) -> DataFrame:
    """``total, pages`` of what ``browse`` goes through; there is one page at least."""
    total = _browsed(groups, members, decision, search).agg(F.count("*").alias("total"))
    return total.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("pages"))


def browse_filters(groups: DataFrame, members: DataFrame, which: str) -> DataFrame:
    """``none``: no duplicates, not dismissed; ``dismissed``; ``registry``; ``suspect``: any quality flag."""
    tests = {"dismissed": F.col("dismissed"), "registry": F.col("origin") == "registry", "suspect": F.size("quality_flags") > 0}
    if which == "none":
        return groups.join(members.select("parent_id").distinct(), "parent_id", "left_anti").where(~F.col("dismissed"))
    return groups.where(tests[which])


def entry(groups: DataFrame, members: DataFrame, parent) -> DataFrame:
    return groups.where(F.col("parent_id") == parent).join(members, "parent_id", "left")


def classify(ids: DataFrame, known: DataFrame, blocked: DataFrame, present: DataFrame, done: str) -> DataFrame:
    """``id, result`` of each distinct id: not_found, skipped (in ``blocked``), already_present, or ``done``. One column each."""
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    rows = ids.select("id").distinct().join(flag(known, "k"), "id", "left").join(flag(blocked, "b"), "id", "left").join(flag(present, "p"), "id", "left")
    return rows.select("id", F.when(F.col("k").isNull(), "not_found").when(F.col("p").isNotNull(), "already_present").when(F.col("b").isNotNull(), "skipped").otherwise(done).alias("result"))


def dismiss(groups: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """Lists with duplicates cannot be dismissed."""
    none = ids.limit(0)
    return classify(ids, groups.select(F.col("parent_id").alias("id")), members.select(F.col("parent_id").alias("id")), none, "updated")


def add_unique(groups: DataFrame, members: DataFrame, cleaned: DataFrame, ids: DataFrame) -> DataFrame:
    """Lists without duplicates go into the cleaned registry."""
    return classify(ids, groups.select(F.col("parent_id").alias("id")), members.select(F.col("parent_id").alias("id")), cleaned.select(F.col("list_id").alias("id")), "added")


def remove_manual(cleaned: DataFrame, replaces: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries that replace others are protected."""
    return classify(ids, cleaned.select(F.col("list_id").alias("id")), replaces.select(F.col("parent_id").alias("id")), ids.limit(0), "removed")


def eligible_unique(groups: DataFrame, members: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Groups without duplicates, not dismissed, not yet in the cleaned registry."""
    return browse_filters(groups, members, "none").join(cleaned.select(F.col("list_id").alias("parent_id")), "parent_id", "left_anti")


def update_decisions(store: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """The store after a review: decided pairs are put in, pending ones taken out, pairs not seen kept; unchanged ones keep their date."""
    now = members.select(pair_key(F.col("parent_id"), F.col("id")).alias("key"), F.col("decision").alias("_new")).groupBy("key").agg(F.max("_new").alias("_new"))
    both = store.join(now, "key", "full_outer")
    same = F.coalesce(F.col("_new") == F.col("decision"), F.lit(False))
    return both.select(
        "key", F.coalesce("_new", "decision").alias("decision"), F.when(F.col("_new").isNull() | same, F.col("updated_at")).otherwise(as_of).alias("updated_at")
    ).where(F.col("decision").isin("approve", "reject"))


def apply_decisions(members: DataFrame, store: DataFrame) -> DataFrame:
    """Earlier decisions on a new registry; ``decision_carried`` marks them."""
    held = store.select("key", F.col("decision").alias("_held"))
    out = members.withColumn("key", pair_key(F.col("parent_id"), F.col("id"))).join(held, "key", "left")
    return out.withColumn("decision", F.coalesce("_held", "decision")).withColumn("decision_carried", F.col("_held").isNotNull()).drop("key", "_held")


def update_marks(store: DataFrame, seen: DataFrame, marked: DataFrame, as_of: Column) -> DataFrame:
    """Marks ``(id, updated_at)``, of dismissed lists or chosen masters, after a review.

    Marked ids are put in, with their old date if they have one; ids of the registry
    (``seen``) that are no longer marked go; marks of lists not seen stay.
    """
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    both = store.join(flag(marked, "_marked"), "id", "full_outer").join(flag(seen, "_seen"), "id", "left")
    return both.where("_marked or _seen is null").select("id", F.coalesce("updated_at", as_of).alias("updated_at"))


def set_dismissed(groups: DataFrame, results: DataFrame, dismissed: bool = True) -> DataFrame:
    """Groups with the flag of those that ``dismiss`` classified as updated."""
    done = results.where("result = 'updated'").select(F.col("id").alias("parent_id"), F.lit(dismissed).alias("_new"))
    return groups.join(done, "parent_id", "left").withColumn("dismissed", F.coalesce("_new", "dismissed")).drop("_new")


def add_entries(cleaned: DataFrame, lists: DataFrame, results: DataFrame) -> DataFrame:
    """Entries with those that ``add_unique`` classified as added; ``lists`` has the columns of ``cleaned``."""
    added = lists.join(results.where("result = 'added'").select(F.col("id").alias("list_id")), "list_id", "left_semi")
    return cleaned.unionByName(added.select(*cleaned.columns))


def drop_entries(cleaned: DataFrame, results: DataFrame) -> DataFrame:
    """Entries without those that ``remove_manual`` classified as removed."""
    return cleaned.join(results.where("result = 'removed'").select(F.col("id").alias("list_id")), "list_id", "left_anti")


def sync_cleaned(cleaned: DataFrame, replaces: DataFrame, members: DataFrame, moved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cleaned, replaces)`` after a review.

    Approved members are added to their parent's replaced lists; members of the same
    parent that are no longer approved are taken out; other replaced lists stay. A
    parent without an entry gets one, an entry that this empties goes, others stay.
    ``moved (parent_id, previous_parent)``: groups whose parent was swapped; they are
    taken out of the entry of the one before.
    """
    approved = members.where("decision = 'approve'").select("parent_id", "id").distinct()
    managed = members.select("parent_id", "id").distinct()
    if moved is not None:
        moved = moved.where("previous_parent is not null and previous_parent <> parent_id").select("parent_id", "previous_parent")
        group = members.select("parent_id", "id").unionByName(moved.select("parent_id", F.col("parent_id").alias("id")))
        managed = managed.unionByName(group.join(moved, "parent_id").select(F.col("previous_parent").alias("parent_id"), "id")).distinct()
    kept = replaces.select("parent_id", "id").join(managed, ["parent_id", "id"], "left_anti")
    new = kept.unionByName(approved).distinct()
    parents = lambda df: df.select(F.col("parent_id").alias("list_id")).distinct()
    emptied = parents(replaces.join(managed, ["parent_id", "id"], "left_semi")).join(parents(new), "list_id", "left_anti")
    entries = cleaned.select("list_id").join(emptied, "list_id", "left_anti").unionByName(parents(approved)).distinct()
    return entries, new


def sync_counters(cleaned: DataFrame, replaces: DataFrame, entries: DataFrame, new: DataFrame) -> DataFrame:
    """``counter, n`` of a sync, from the tables before and after it."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    ids, pairs = "list_id", ["parent_id", "id"]
    parts = [
        one("entries_created", entries.join(cleaned, ids, "left_anti")), one("entries_deleted", cleaned.join(entries, ids, "left_anti")),
        one("replaces_added", new.join(replaces, pairs, "left_anti")), one("replaces_removed", replaces.join(new, pairs, "left_anti")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def replaced_codes(replaces: DataFrame, codes: DataFrame) -> DataFrame:
    """``parent_id, id, pos, value, label``: the codes of replaced lists that the current registry has, one row of nulls for the others.

    ``codes (list_id, pos, value, label)``: those of the registry's members.
    """
    return replaces.join(codes.select(F.col("list_id").alias("id"), "pos", "value", "label"), "id", "left").select("parent_id", "id", "pos", "value", "label")


def swap_parent(members: DataFrame, groups: DataFrame, links: DataFrame, swaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members after each ``(parent_id, new_parent_id)`` of ``swaps``, and the refused swaps with a reason.

    The old parent becomes a pending duplicate of the new one; decisions of the
    others stay. Refused: unknown parent or member, registry parents, members
    without links.
    """
    checked = (
        swaps.join(groups.select("parent_id", "origin"), "parent_id", "left")
        .join(members.select("parent_id", F.col("id").alias("new_parent_id"), F.lit(True).alias("_member")), ["parent_id", "new_parent_id"], "left")
        .join(links.select(F.col("id").alias("new_parent_id"), F.lit(True).alias("_linked")).distinct(), "new_parent_id", "left")
        .withColumn("reason", F.when(F.col("origin").isNull() | F.col("_member").isNull(), "unknown").when(F.col("origin") == "registry", "registry").when(F.col("_linked").isNull(), "no links"))
    )
    good = checked.where("reason is null").select("parent_id", "new_parent_id")
    moved = members.join(good, "parent_id", "left")
    stay = moved.where(F.col("new_parent_id").isNull() | (F.col("id") != F.col("new_parent_id"))).select(F.coalesce("new_parent_id", "parent_id").alias("parent_id"), "id", "decision")
    old = good.select(F.col("new_parent_id").alias("parent_id"), F.col("parent_id").alias("id"), F.lit("pending").alias("decision"))
    return stay.unionByName(old), checked.where("reason is not null").select("parent_id", "new_parent_id", "reason")


def swapped_registry(members: DataFrame, groups: DataFrame, links: DataFrame, swaps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, groups, refused)`` after ``swap_parent``, with at most one swap for each group.

    ``links (id, links)``: fused pairs of each member, as ``grouping.links`` gives them.
    Members of swapped groups are detected anew against the new parent; those of
    others stay as they are. Groups keep their order; swapped ones are marked
    ``master_chosen`` and name their ``previous_parent``, so swapping back restores
    the members (with the decision on the old parent pending).
    """
    after, refused = swap_parent(members, groups, links.where(F.size("links") > 0), swaps)
    done = swaps.join(refused.select("parent_id"), "parent_id", "left_anti").select("parent_id", "new_parent_id")
    new = done.select(F.col("new_parent_id").alias("parent_id"))
    columns = ["parent_id", "id", "decision", "detection_types", "confidence", "via"]
    linked = after.join(new, "parent_id", "left_semi").join(links, "id", "left").withColumn("links", F.coalesce("links", F.array().cast(links.schema["links"].dataType)))
    old = members.join(done.select("parent_id"), "parent_id", "left_anti").select(columns)
    moved = groups.join(done, "parent_id", "left")
    moved = moved.withColumn("master_chosen", F.col("new_parent_id").isNotNull() | F.coalesce("master_chosen", F.lit(False))) if "master_chosen" in groups.columns else moved.withColumn("master_chosen", F.col("new_parent_id").isNotNull())
    moved = moved.withColumn("previous_parent", F.when(F.col("new_parent_id").isNotNull(), F.col("parent_id"))).withColumn("parent_id", F.coalesce("new_parent_id", "parent_id")).drop("new_parent_id")
    return against_parent(linked).select(columns).unionByName(old), moved, refused


def validate_cleaned(entries: DataFrame) -> DataFrame:
    """``list_id, path, message`` of each failed check of ``list_id, key, codes`` (array of arrays of strings)."""
    codes = F.posexplode_outer("codes").alias("pos", "code")
    each = entries.select("list_id", codes).where("pos is not null")
    path = F.concat(F.lit("codes["), "pos", F.lit("]"))
    bad = each.select("list_id", path.alias("path"), F.when(F.size("code") != 2, "not a pair").when(F.trim(F.col("code")[0]) == "", "blank value").alias("message"))
    key = entries.select("list_id", F.lit("id").alias("path"), F.when(~F.col("list_id").eqNullSafe(F.col("key")), "id is not the key").alias("message"))
    return bad.unionByName(key).where("message is not null")


def edit_entries(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries ``(list_id, name, label, ...)`` after edits ``(list_id, op, field, new_value, seq)``: ``set`` a name or label (the latest wins), ``delete`` the entry."""
    last = lambda field: F.max_by(F.when(F.col("field") == field, F.col("new_value")), F.when(F.col("field") == field, F.col("seq"))).alias(f"_{field}")
    sets = edits.where("op = 'set'").groupBy("list_id").agg(last("name"), last("label"))
    kept = entries.join(edits.where("op = 'delete'").select("list_id"), "list_id", "left_anti").join(sets, "list_id", "left")
    return kept.withColumn("name", F.coalesce("_name", "name")).withColumn("label", F.coalesce("_label", "label")).drop("_name", "_label")


def migrate_v1(documents: DataFrame) -> DataFrame:
    """``replaces`` from its own column or that of the first version, never null."""
    return documents.withColumn("replaces", F.coalesce("replaces", "merged_duplicates", F.array().cast("array<string>"))).drop("merged_duplicates")


def edit_cleaned(codes: DataFrame, edits: DataFrame) -> DataFrame:
    """Codes ``(list_id, pos, value, label)`` after edits ``(list_id, op, pos, field, new_value, seq)``.

    ``set``: the latest for a field wins; ``delete``: drops a code; ``append``: adds one
    behind the last, in order of ``seq``. Positions are closed up again.
    """
    sets = edits.where("op = 'set'").groupBy("list_id", "pos", "field").agg(F.max_by("new_value", "seq").alias("v"))
    wide = sets.groupBy("list_id", "pos").agg(F.max(F.when(F.col("field") == "value", F.col("v"))).alias("_value"), F.max(F.when(F.col("field") == "label", F.col("v"))).alias("_label"))
    gone = edits.where("op = 'delete'").select("list_id", "pos").distinct()
    kept = codes.join(wide, ["list_id", "pos"], "left").join(gone, ["list_id", "pos"], "left_anti").select("list_id", F.lit(0).alias("s"), "pos", F.coalesce("_value", "value").alias("value"), F.coalesce("_label", "label").alias("label"))
    added = edits.where("op = 'append'").select("list_id", F.lit(1).alias("s"), F.col("seq").alias("pos"), F.col("new_value").alias("value"), F.lit("").alias("label"))
    rows = kept.unionByName(added).groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("s", "pos", "value", "label"))).alias("c"))
    return rows.select("list_id", F.posexplode("c").alias("pos", "c")).select("list_id", "pos", "c.value", "c.label")
