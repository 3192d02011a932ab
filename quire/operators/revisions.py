"""Revisions of files that were changed by appending: which objects each had."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import fixed
from quire.operators.trees import chained
from quire.session import materialize


def revisions(xref_sections: DataFrame) -> DataFrame:
    """doc_id, start, revision: cross-reference sections in the order that they were
    written, from 0. The chain of Prev from the newest section is ranked by pointer
    doubling; where it comes back to a section, that section's first place counts."""
    own = xref_sections.select("doc_id", "start", "prev", "newest")
    heads = own.where("newest").select("doc_id", F.col("start").alias("node"), F.lit(-1).cast("long").alias("up"))
    following = own.where("prev is not null").select("doc_id", F.col("prev").alias("node"), F.col("start").alias("before"))
    ranked = chained(heads, following, F.desc).where("not lost and up is not null")
    of = Window.partitionBy("doc_id").orderBy(F.desc("place"))
    return ranked.select("doc_id", F.col("node").alias("start"), (F.row_number().over(of) - 1).alias("revision"))


def in_force(sections: DataFrame) -> DataFrame:
    """doc_id, obj_num, entry_type, offset, gen_or_index, since, until: each entry with the
    first and the last revision that it holds for. Of a section's entries of one object
    the first counts; an entry holds until a later section has the object.

    sections: the table `document_sections`, or `xref_sections`, whose rows are gathered. In
    most files each section leads to the next one before it; these are ranked and their
    entries held against each other in their row. Others are ranked by revisions()."""
    gathered = sections if "sections" in sections.columns else sections.groupBy("doc_id").agg(F.collect_list(F.struct("start", "prev", "newest", "entries")).alias("sections"))
    own = gathered.withColumn("sections", fixed(F.sort_array("sections", asc=False)))
    n = F.size("sections")
    leads = F.zip_with(F.slice(F.col("sections.prev"), F.lit(1), n - 1), F.slice(F.col("sections.start"), F.lit(2), n), lambda p, s: p.eqNullSafe(s))
    backward = F.coalesce(F.get("sections", F.lit(0))["newest"] & F.forall(leads, lambda x: x), F.lit(False))
    own = materialize(own.where(n > 0).withColumn("backward", backward), "sections")
    held, rest = _in_rows(own.where("backward")), own.where("not backward")
    return held if rest.isEmpty() else held.unionByName(_by_ranks(rest.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")))


def _in_rows(own: DataFrame) -> DataFrame:
    newest = F.size("sections") - 1
    entry = lambda e, revision, place: F.struct(e["obj_num"].alias("obj_num"), revision.alias("revision"), place.alias("place"), e["entry_type"].alias("entry_type"), e["offset"].alias("offset"), e["gen_or_index"].alias("gen_or_index"))
    placed = F.flatten(F.transform("sections", lambda s, i: F.transform(s["entries"], lambda e, k: entry(e, newest - i, k))))
    own = own.select("doc_id", newest.alias("newest"), fixed(F.sort_array(placed)).alias("all"))
    before = lambda i: F.get(F.col("all"), i - 1)
    first = F.filter("all", lambda e, i: (i == 0) | (before(i)["obj_num"] != e["obj_num"]) | (before(i)["revision"] != e["revision"]))
    own = own.select("doc_id", "newest", fixed(first).alias("one"))
    after = lambda i: F.get(F.col("one"), i + 1)
    until = lambda e, i: F.coalesce(F.when(after(i)["obj_num"] == e["obj_num"], after(i)["revision"] - 1), F.col("newest"))
    rows = own.select("doc_id", F.explode(F.transform("one", lambda e, i: F.struct(e.alias("e"), until(e, i).alias("until")))).alias("h"))
    return rows.select("doc_id", "h.e.obj_num", "h.e.entry_type", "h.e.offset", "h.e.gen_or_index", F.col("h.e.revision").alias("since"), "h.until")


def _by_ranks(xref_sections: DataFrame) -> DataFrame:
    ranked = materialize(revisions(xref_sections), "ranked")
    placed = xref_sections.select("doc_id", "start", F.posexplode("entries").alias("place", "e")).join(ranked.hint("merge"), ["doc_id", "start"])
    newest = ranked.groupBy("doc_id").agg(F.max("revision").alias("newest"))
    rows = placed.select("doc_id", "revision", "place", "e.*")
    first = Window.partitionBy("doc_id", "obj_num", "revision").orderBy("place")
    one = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "place")
    later = F.lead("revision").over(Window.partitionBy("doc_id", "obj_num").orderBy("revision"))
    held = one.withColumn("_later", later).join(newest.hint("merge"), "doc_id")
    return held.select("doc_id", "obj_num", "entry_type", "offset", "gen_or_index", F.col("revision").alias("since"), F.coalesce(F.col("_later") - 1, F.col("newest")).alias("until"))


def as_of(held: DataFrame, revision: int) -> DataFrame:
    """The entries of in_force that hold for one revision."""
    return held.where((F.col("since") <= revision) & (F.col("until") >= revision))


def each_revision(held: DataFrame) -> DataFrame:
    """The entries of in_force once for each revision that they hold for."""
    return held.withColumn("revision", F.explode(F.sequence("since", "until")))
