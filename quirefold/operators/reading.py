"""List runs, inline segments, captions, targets and backlinks, as window operations and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import utf16_length
from .ordering import column_rank  # noqa: F401  (part of the operator family)


def runs_of(rows: DataFrame, is_member: Column, keys: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Members in unbroken succession share a run number, from 0; rows that are none are dropped. Gaps and islands."""
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumns({"_member": is_member, "_breaks": F.sum((~is_member).cast("int")).over(w)})
    found = numbered.filter("_member")
    return found.withColumn(name, F.dense_rank().over(W.partitionBy(*keys).orderBy("_breaks")) - 1).drop("_member", "_breaks")


def attribute(name: str, kind: str) -> Column:
    """One typed attribute of a block: kind is s, d or b."""
    return F.col("attributes")[name][kind]


def list_items(blocks: DataFrame) -> DataFrame:
    """List items with their run, level, order, ordinal and list id; furniture neither takes part nor breaks a run."""
    level, ordinal = attribute("listLevel", "d"), attribute("listOrdinal", "d")
    whole = lambda x: F.when(x == F.floor(x), x.cast("long"))
    found = runs_of(blocks.filter("kind <> 'furniture'"), F.col("kind") == "list-item", ["doc_key"], ["pos"])
    return found.select(
        "doc_key", "run", "pos", "id", F.greatest(F.coalesce(whole(level), F.lit(0)), F.lit(0)).alias("level"),
        F.coalesce(attribute("listOrdered", "b"), attribute("ordered", "b"), F.lit(False)).alias("ordered"),
        F.when(whole(ordinal) >= 0, whole(ordinal)).alias("ordinal"), attribute("listId", "s").alias("list_id"),
        (whole(level).isNotNull() | attribute("listOrdered", "b").isNotNull()).alias("declares_nesting"),
    )


def flat_lists(items: DataFrame) -> DataFrame:
    """Items of runs in which none declares nesting, by list: consecutive items of equal list id; the first decides the order."""
    w = W.partitionBy("doc_key", "run").orderBy("pos")
    plain = items.withColumn("_nested", F.bool_or("declares_nesting").over(W.partitionBy("doc_key", "run"))).filter("not _nested")
    changed = plain.withColumn("_new", (F.row_number().over(w) == 1) | ~F.col("list_id").eqNullSafe(F.lag("list_id").over(w)))
    numbered = changed.withColumn("list", F.sum(F.col("_new").cast("int")).over(w) - 1)
    return numbered.withColumn("ordered", F.first("ordered").over(W.partitionBy("doc_key", "run", "list").orderBy("pos"))).drop("_new", "_nested")


def segments(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Text cut at every start and end of its inline runs: keys, start, end, owners (the covering runs' positions).

    runs: keys, text_units, run_pos, start, end. Owners come by start, then longest first, then position. Runs of no
    width own nothing. Segments of a text are numbered, and a run finds its first and last one by equality of their
    bounds, so rows grow with what runs cover, not with runs times segments.
    """
    solid = runs.filter("`end` > start")
    w = W.partitionBy(*keys).orderBy("start")
    cuts = (
        solid.select(*keys, F.explode(F.array(F.lit(0).cast("long"), "text_units", "start", "end")).alias("start")).distinct()
        .withColumn("end", F.lead("start").over(w)).withColumn("_nth", F.row_number().over(w)).filter("`end` is not null")
    )
    own = solid.select(*keys, F.struct("start", (-F.col("end")).alias("minus_end"), "run_pos").alias("owner"), "start", "end")
    begun = own.join(cuts.select(*keys, "start", F.col("_nth").alias("_first")), [*keys, "start"])
    spans = begun.join(cuts.select(*keys, "end", F.col("_nth").alias("_last")), [*keys, "end"])
    held = spans.select(*keys, F.explode(F.sequence("_first", "_last")).alias("_nth"), "owner").groupBy(*keys, "_nth").agg(F.array_sort(F.collect_list("owner")).alias("owners"))
    out = cuts.join(held, [*keys, "_nth"], "left").drop("_nth")
    return out.withColumn("owners", F.coalesce(F.transform("owners", lambda o: o["run_pos"]), F.array().cast("array<int>")))


RUN = ["doc_key", "block_pos", "cell_pos"]


def segment_owners(t: dict[str, DataFrame]) -> DataFrame:
    """Segments of all inline texts (doc_key, block_pos, cell_pos, start, end) with the run that each is wrapped by.

    wrapper is the position of the first owner that refers by role and relationship, and by is 'reference'; else of
    the first owner that links, and by is 'link'; null where an owner only marks or there is none.
    """
    runs = t["runs"] if "text_units" in t["runs"].columns else t["runs"].withColumn("text_units", utf16_length(F.col("text")))
    refers = F.col("semanticRole").isNotNull() & F.col("relationshipId").isNotNull()
    links = F.col("href").isNotNull() | (F.size("targetIds") > 0)
    facts = runs.select(*RUN, "run_pos", F.when(refers, 0).when(links, 1).alias("rank")).filter("rank is not null")
    cut = segments(runs, RUN)
    owned = cut.select(*RUN, "start", F.posexplode("owners").alias("place", "run_pos")).join(facts, [*RUN, "run_pos"])
    best = owned.groupBy(*RUN, "start").agg(F.min(F.struct("rank", "place", "run_pos")).alias("best"))
    by = F.when(F.col("best.rank") == 0, "reference").when(F.col("best.rank") == 1, "link")
    return cut.join(best, [*RUN, "start"], "left").select(*RUN, "start", "end", F.col("best.run_pos").alias("wrapper"), by.alias("by"))


def reference_targets(t: dict[str, DataFrame]) -> DataFrame:
    """What each referring run points to: doc_key, block_pos, cell_pos, run_pos, n, target, label, kind, href.

    A matched relationship's ends count, in order; of any other status, or of none, the run's own targets. Labels are
    the parts of the relationship's label, or else numbers from 1.
    """
    runs = t["runs"].filter("semanticRole is not null and relationshipId is not null").select(*RUN, "run_pos", "targetIds", F.col("relationshipId").alias("id"))
    edges = t["edges"].select("doc_key", "id", "status", "to", F.filter(F.transform(F.split(F.coalesce("label", F.lit("")), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "").alias("labels"))
    joined = runs.join(edges, ["doc_key", "id"], "left")
    ends = F.when(F.col("status") == "matched", F.col("to")).otherwise(F.col("targetIds"))
    flat = joined.select(*RUN, "run_pos", "labels", F.posexplode(ends).alias("n", "target"))
    label = F.coalesce(F.get("labels", F.col("n")), (F.col("n") + 1).cast("string"))
    return resolved_targets(flat.withColumn("label", label).drop("labels"), t)


def notes_by_author(t: dict[str, DataFrame]) -> DataFrame:
    """doc_key, author_pos, author, notes (label, id, target) in order; an author without notes has none."""
    authors = t["documents"].select("doc_key", F.posexplode("doc.metadata.authors").alias("author_pos", "author"))
    held = t["notes"].groupBy("doc_key", "author").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "id", "target"))).alias("notes"))
    notes = F.transform("notes", lambda x: F.struct(x["label"].alias("label"), x["id"].alias("id"), x["target"].alias("target")))
    return authors.join(held, ["doc_key", "author"], "left").select("doc_key", "author_pos", "author", F.coalesce(notes, F.array().cast("array<struct<label:string,id:string,target:string>>")).alias("notes"))


def first_emission(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Rows with `first`: whether they are the first of their name."""
    return rows.withColumn("first", F.row_number().over(W.partitionBy(*keys, name).orderBy(*order)) == 1)


def attached_captions(t: dict[str, DataFrame]) -> DataFrame:
    """doc_key, host_id, caption_id, edge_id, ok: matched caption edges from a host to a caption; ok where each has only the other."""
    # blocks may be exploded from rows or stored in far fewer bytes than they take, so no estimate may broadcast them
    kinds = t["blocks"].select("doc_key", "id", "kind", F.trim("text").alias("said")).hint("merge")
    pairs = (
        t["edges"].filter("kind = 'caption' and status = 'matched'").select("doc_key", F.col("id").alias("edge_id"), F.col("pos").alias("edge_pos"), F.col("from").alias("host_id"), F.explode("to").alias("caption_id"))
        .withColumn("caption_id", F.regexp_replace("caption_id", "^#", ""))
        .join(kinds.filter("kind in ('figure', 'table', 'equation')").select("doc_key", F.col("id").alias("host_id"), F.col("said").alias("host_text")), ["doc_key", "host_id"])
        .join(kinds.filter("kind = 'caption'").select("doc_key", F.col("id").alias("caption_id"), F.col("said").alias("caption_text")), ["doc_key", "caption_id"])
    )
    # the last join has dealt the pairs by caption, so only the windows over hosts deal them again
    alone = lambda x, key: F.min(x).over(W.partitionBy("doc_key", key)) == F.max(x).over(W.partitionBy("doc_key", key))
    counted = pairs.withColumn("_one_host", alone("host_id", "caption_id")).withColumn("_one_caption", alone("caption_id", "host_id"))
    agree = (F.col("host_text") == "") | (F.col("host_text") == F.col("caption_text"))
    return counted.select("doc_key", "host_id", "caption_id", "edge_id", (F.col("_one_caption") & F.col("_one_host") & agree).alias("ok"))


def resolved_targets(targets: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """targets (doc_key, target, ...) with kind (asset, block, furniture, external, unknown) and href; assets go before blocks."""
    plain = targets.withColumn("_id", F.regexp_replace("target", "^#", ""))
    assets = t["assets"].select("doc_key", F.col("id").alias("_id"), F.col("href").alias("_asset"))
    blocks = t["blocks"].select("doc_key", F.col("id").alias("_id"), F.col("kind").alias("_block"))
    kind = F.when(F.col("_asset").isNotNull(), "asset").when(F.col("_block") == "furniture", "furniture").when(F.col("_block").isNotNull(), "block").when(F.col("target").rlike(r"\A(?:https?|mailto):"), "external").otherwise("unknown")
    href = F.coalesce("_asset", F.when(F.col("_block").isNotNull(), F.concat(F.lit("#"), "_id")), F.when(F.col("target").rlike(r"\A(?:https?|mailto):"), F.col("target")))
    return plain.join(assets, ["doc_key", "_id"], "left").join(blocks, ["doc_key", "_id"], "left").withColumns({"kind": kind, "href": href}).drop("_id", "_asset", "_block")


def note_backlinks(t: dict[str, DataFrame]) -> DataFrame:
    """doc_key, note_id, edge_ids: matched foot- and endnote edges that some run carries, by the note they point to."""
    shown = t["runs"].filter("relationshipId is not null and semanticRole is not null").select("doc_key", F.col("relationshipId").alias("id")).distinct()
    edges = t["edges"].filter("status = 'matched' and kind in ('footnote', 'endnote')").join(shown, ["doc_key", "id"], "left_semi")
    flat = edges.select("doc_key", "pos", "id", F.explode("to").alias("note_id")).withColumn("note_id", F.regexp_replace("note_id", "^#", ""))
    return flat.groupBy("doc_key", "note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("edge_ids"))


def figure_artwork(t: dict[str, DataFrame]) -> DataFrame:
    """doc_key, block_pos, hrefs of the block's fallback assets, in order; those that don't exist are left out."""
    wanted = t["blocks"].select("doc_key", F.col("pos").alias("block_pos"), F.posexplode("fallbackAssetIds").alias("n", "id"))
    found = wanted.join(t["assets"].select("doc_key", "id", "href"), ["doc_key", "id"])
    return found.groupBy("doc_key", "block_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda x: x["href"]).alias("hrefs"))


def asset_budget(assets: DataFrame, most: int) -> DataFrame:
    """Assets with the bytes up to and including each, and whether they are within the budget."""
    size = F.coalesce(F.octet_length(F.unbase64("bytes")), F.lit(0))
    return assets.withColumn("so_far", F.sum(size).over(W.partitionBy("doc_key").orderBy("pos"))).withColumn("within", F.col("so_far") <= most)


def set_difference(left: DataFrame, right: DataFrame, on: list[str], facts: list[str]) -> DataFrame:
    """Full comparison of two sets by key: rows that one side lacks, or whose facts differ."""
    a = left.select(*on, F.struct(*facts).alias("_left"))
    b = right.select(*on, F.struct(*facts).alias("_right"))
    state = F.when(F.col("_right").isNull(), "missing").when(F.col("_left").isNull(), "extra").when(~F.col("_left").eqNullSafe(F.col("_right")), "differs")
    return a.join(b, on, "full_outer").select(*on, state.alias("state")).filter("state is not null")
