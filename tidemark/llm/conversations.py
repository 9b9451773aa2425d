"""Conversations rebuilt from message rows by assembling overlapping fragments.

A fragment is a bounded run of message hashes of one conversation, as an export of a period has it. Fragments are linked
where a suffix of one equals a prefix of another, contained fragments are absorbed, unambiguous links are merged to paths by pointer
doubling, and a conversation whose fragments do not form exactly one path has a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.runtime import cut, require_columns

#: Messages of an export period, about; a fragment covers two periods, so every collected array is bounded.
PAGE = 32
_HOUR = 3_600_000


def matches(fragments: DataFrame) -> DataFrame:
    """How ``fragments`` (conversation, fragment, hashes) meet: conversation, a, b, start, shared, n_a, n_b, for all pairs with a <> b where b from
    its first message on equals a from message ``start`` (from 0) on, for ``shared`` messages, up to the end of a or of b.

    A pair is looked at where b's first message occurs in a, so there are no more pairs than fragments that contain that message.
    """
    sized = fragments.where(F.size("hashes") > 0)
    inside = sized.select("conversation", F.col("fragment").alias("a"), F.posexplode("hashes").alias("start", "first"))
    heads = sized.select("conversation", F.col("fragment").alias("b"), F.get("hashes", F.lit(0)).alias("first"))
    pairs = inside.join(heads, ["conversation", "first"]).where("a <> b").drop("first")
    pairs = pairs.join(sized.select("conversation", F.col("fragment").alias("a"), F.col("hashes").alias("of_a")), ["conversation", "a"])
    pairs = pairs.join(sized.select("conversation", F.col("fragment").alias("b"), F.col("hashes").alias("of_b")), ["conversation", "b"])
    shared = F.least(F.size("of_a") - F.col("start"), F.size("of_b"))
    same = F.expr("slice(of_a, start + 1, shared) = slice(of_b, 1, shared)")
    return pairs.withColumn("shared", shared).where(same).select("conversation", "a", "b", "start", "shared", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"))


def overlap_links(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, absorbed) of ``fragments`` (conversation, fragment LONG, hashes ARRAY<LONG>), no two of which have equal hashes.

    absorbed: conversation, fragment, within, start: fragments that another one contains, with the longest container (then the smallest id and start).
    links: conversation, fragment, previous, advance (messages from the start of previous to the start of fragment). Of the suffix-prefix
    matches between fragments that are not absorbed the longest counts, whatever its length. A fragment with two equally long successors, or
    two fragments with the same successor, get no link there.
    """
    met = cut(matches(fragments))
    inner = met.where("shared = n_b").select("conversation", F.col("b").alias("fragment"), F.col("a").alias("within"), "start", F.col("n_a").alias("n"))
    absorbed = cut(
        inner.groupBy("conversation", "fragment").agg(F.min(F.struct(-F.col("n"), "within", "start")).alias("m"))
        .select("conversation", "fragment", "m.within", "m.start")
    )
    gone = absorbed.select("conversation", "fragment")
    pairs = met.where("shared < n_a AND shared < n_b").select("conversation", F.col("a").alias("previous"), F.col("b").alias("fragment"), F.col("shared").alias("n"), F.col("start").alias("advance"))
    pairs = pairs.join(gone, ["conversation", "fragment"], "left_anti").join(gone.withColumnRenamed("fragment", "previous"), ["conversation", "previous"], "left_anti")
    # Per side: the longest overlap, how many partners share it, and one of them. No set of partners is collected.
    after = pairs.groupBy("conversation", "previous", "n").agg(F.count("*").alias("k"), F.min("fragment").alias("fragment"), F.min("advance").alias("advance"))
    after = after.groupBy("conversation", "previous").agg(F.max_by(F.struct("k", "fragment", "advance"), "n").alias("m")).where("m.k = 1")
    before = pairs.groupBy("conversation", "fragment", "n").agg(F.count("*").alias("k"), F.min("previous").alias("previous"))
    before = before.groupBy("conversation", "fragment").agg(F.max_by(F.struct("k", "previous"), "n").alias("m")).where("m.k = 1")
    links = after.select("conversation", "previous", "m.fragment", "m.advance").join(before.select("conversation", "fragment", "m.previous"), ["conversation", "fragment", "previous"])
    return links, absorbed


def assemble_fragments(fragments: DataFrame) -> DataFrame:
    """Place of every fragment of ``fragments`` (conversation, fragment LONG, hashes ARRAY<LONG>).

    Result: conversation, fragment, head (first fragment of its path) and offset (messages from the start of the path, -1 on a circle).
    Copies of a fragment (equal hashes) count once, under the smallest id. A fragment that another one contains has a place on the container's
    path. ``fragment`` must be unique over all conversations. Empty fragments stand alone. Null ids or hashes are no fragments.
    """
    require_columns(fragments, ["conversation", "fragment", "hashes"])
    own = (
        fragments.where("conversation IS NOT NULL AND fragment IS NOT NULL AND hashes IS NOT NULL")
        .groupBy("conversation", "hashes").agg(F.min("fragment").alias("fragment"))
    )
    links, absorbed = overlap_links(own)
    nodes = own.select("conversation", "fragment").join(absorbed.select("conversation", "fragment"), ["conversation", "fragment"], "left_anti")
    nodes = cut(nodes.join(links, ["conversation", "fragment"], "left"))
    placed = resolve_hierarchy(nodes.select(F.col("fragment").alias("id"), F.col("previous").alias("parent_id"), F.coalesce("advance", F.lit(0)).alias("advance")), weight="advance")
    placed = nodes.select("conversation", "fragment").join(placed.select(F.col("id").alias("fragment"), F.col("root_id").alias("head"), F.col("depth").alias("offset")), "fragment")
    # The longest container of a contained fragment is contained in no other.
    of = placed.select("conversation", F.col("fragment").alias("within"), "head", F.col("offset").alias("base"))
    inner = absorbed.join(of, ["conversation", "within"]).select("conversation", "fragment", "head", F.when(F.col("base") < 0, -1).otherwise(F.col("base") + F.col("start")).alias("offset"))
    return placed.select("conversation", "fragment", "head", "offset").unionByName(inner)


def export_periods(messages: DataFrame, page: int = PAGE) -> DataFrame:
    """``messages`` (conversation, message_id, at, author, role; no nulls in the first three) by export period.

    A period is a run of whole hours with about ``page`` messages of the conversation; an hour with more is divided by instant and id. Result, one row for each
    period: conversation, period (a sortable STRUCT), own, the ARRAY of its messages in order (at most about twice ``page``). Hours are counted
    first and added up per conversation, so no task sees all messages of one conversation.
    """
    hour = F.floor(F.col("at") / _HOUR).alias("hour")
    hours = messages.groupBy("conversation", hour).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conversation").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    small = F.col("n") <= page
    # Hours that go together carry the first of them as their name, a full hour its own.
    run = F.when(small, F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / page))
    named = hours.withColumn("run", run).withColumn("from", F.when(small, F.min("hour").over(Window.partitionBy("conversation", "run"))).otherwise(F.col("hour")))
    rows = messages.withColumn("hour", hour).join(named.select("conversation", "hour", "from", small.alias("small")), ["conversation", "hour"])
    place = Window.partitionBy("conversation", "hour").orderBy("at", "message_id")
    full = rows.where(~F.col("small")).withColumn("part", F.floor((F.row_number().over(place) - 1) / page))
    parted = rows.where("small").withColumn("part", F.lit(0).cast("long")).unionByName(full)
    message = F.struct("at", "message_id", "author", "role")
    return parted.groupBy("conversation", F.struct("from", "part").alias("period")).agg(F.array_sort(F.collect_list(message)).alias("own"))


def export_fragments(messages: DataFrame, page: int = PAGE) -> DataFrame:
    """Fragments of ``messages``: each covers a period of ``export_periods`` and the next one of its conversation, as overlapping exports do.

    Result: conversation, fragment (a hash of its messages, which says nothing about their order), own (messages of its first period) and hashes.
    """
    periods = cut(export_periods(messages, page))
    following = Window.partitionBy("conversation").orderBy("period")
    keys = periods.select("conversation", "period").withColumn("next", F.lead("period").over(following))
    then = periods.select("conversation", F.col("period").alias("next"), F.col("own").alias("more"))
    hashed = lambda own: F.transform(own, lambda m: F.xxhash64("conversation", m["message_id"], m["at"], m["author"]))
    none = F.array().cast(periods.schema["own"].dataType)
    joined = periods.join(keys, ["conversation", "period"]).join(then, ["conversation", "next"], "left")
    out = joined.select("conversation", "own", hashed(F.concat("own", F.coalesce("more", none))).alias("hashes"))
    return out.select("conversation", F.xxhash64("conversation", "hashes").alias("fragment"), "own", "hashes")


def read_rows(messages: DataFrame) -> DataFrame:
    """``messages`` without null conversations or ids, each conversation and id once, cut."""
    require_columns(messages, ["conversation", "message_id", "at", "author", "role", "visible", "opening"])
    kept = F.max(F.struct("visible", "at", "author", "role")).alias("m")
    rows = messages.where("conversation IS NOT NULL AND message_id IS NOT NULL").groupBy("conversation", "message_id").agg(kept, F.max("opening").alias("opening"))
    return cut(rows.select("conversation", "message_id", "m.*", "opening"))


def rebuild_conversations(messages: DataFrame, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(conversations, placed messages) of ``messages``.

    ``messages``: conversation LONG, message_id LONG, at LONG (null: unknown), author (null: unknown), role (user, assistant
    or system), visible BOOLEAN, opening BOOLEAN; extra columns are ignored. A conversation and id count once.

    Visible messages of known time are laid out as overlapping fragments by ``export_fragments``; order and positions come from
    ``rebuild_from_fragments`` alone.

    conversations: conversation, broken, and the reasons no_opening, unusable_row (a visible message without known time or
    author), empty (no visible message that is not the system's), gap, first_not_user, last_not_assistant.
    placed messages: conversation, message_id, position (from 0), role, author, at, of all conversations. Empty tables give no rows.
    """
    rows = read_rows(messages)
    usable = rows.where("visible AND at IS NOT NULL").select("conversation", "message_id", "at", "author", "role")
    return rebuild_from_fragments(rows, cut(export_fragments(usable, page)))


def rebuild_from_fragments(rows: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``rebuild_conversations``, from ``rows`` (of ``read_rows``) and ``fragments`` (of ``export_fragments``), some of which may be missing.

    Fragments of a conversation that has only one need no partner; all others are assembled by their overlaps.
    """
    facts = rows.groupBy("conversation").agg(
        F.max("opening").alias("opened"),
        F.max(F.col("visible") & (F.col("at").isNull() | F.col("author").isNull())).alias("unusable_row"),
    )
    several = fragments.groupBy("conversation").agg(F.count("*").alias("k")).where("k > 1").select("conversation")
    many = fragments.join(several, "conversation", "left_semi")
    assembled = cut(assemble_fragments(many.select("conversation", "fragment", "hashes")))
    placed = fragments.select("conversation", "fragment", "own").join(assembled, ["conversation", "fragment"], "left")
    placed = placed.withColumns({"head": F.coalesce("head", "fragment"), "offset": F.coalesce("offset", F.lit(0).cast("long"))})
    spoken = F.filter(F.transform("own", lambda m: m["role"]), lambda r: r != "system")
    ends = placed.select("conversation", "head", "offset", F.get(spoken, F.lit(0)).alias("first"), F.get(spoken, F.size(spoken) - 1).alias("last"))
    paths = ends.groupBy("conversation").agg(
        F.min("head").alias("low"), F.max("head").alias("high"), F.min("offset").alias("least"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("offset"))).alias("first_role"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("offset"))).alias("last_role"),
    )
    judged = facts.join(paths, "conversation", "left").select(
        "conversation",
        (~F.coalesce("opened", F.lit(False))).alias("no_opening"),
        F.coalesce("unusable_row", F.lit(False)).alias("unusable_row"),
        F.col("first_role").isNull().alias("empty"),
        F.coalesce((F.col("low") != F.col("high")) | (F.col("least") < 0), F.lit(False)).alias("gap"),
        F.coalesce(F.col("first_role") != "user", F.lit(False)).alias("first_not_user"),
        F.coalesce(F.col("last_role") != "assistant", F.lit(False)).alias("last_not_assistant"),
    )
    reasons = ["no_opening", "unusable_row", "empty", "gap", "first_not_user", "last_not_assistant"]
    broken = F.col(reasons[0])
    for r in reasons[1:]:
        broken = broken | F.col(r)
    positions = placed.select("conversation", "offset", F.posexplode("own").alias("i", "m")).select(
        "conversation", "m.message_id", (F.col("offset") + F.col("i")).alias("position"), "m.role", "m.author", "m.at"
    )
    return judged.withColumn("broken", broken), positions
