"""Discovery of capabilities: wide members of leaves, merging over sources, names and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored
from . import similarity

# Bounds of a name, and what a summary for naming holds at most.
NAME_LENGTH, NAME_WORDS = 48, 5
SUMMARY_FOLDERS, SUMMARY_FIELDS = 12, 8


def leaves(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item_id, source, cluster) and (cluster, source, common) of items (item_id, source, signature) of similar signatures.

    A cluster's common tokens are those of all its members; where there are none,
    those of its smallest member. They are found over the different signatures.
    """
    named = stored(similarity.signature_clusters(items, threshold), "signature-clusters")
    signed = similarity.signed(items)
    members = signed.select("item_id", "source", "sig_id").join(named.hint("shuffle_hash"), "sig_id").drop("sig_id")
    own = F.min_by(F.array_sort("signature"), "item_id").alias("own")
    kinds = signed.groupBy("source", "sig_id", _tokens().alias("signature")).agg(F.min("item_id").alias("item_id"), own)
    known = stored(kinds.join(named.hint("shuffle_hash"), "sig_id").drop("sig_id"), "signatures")
    first = known.groupBy("cluster").agg(F.min_by(F.struct("source", "own"), "item_id").alias("f"))
    found = first.join(similarity.common_signature(known), "cluster", "left")
    return members, found.select("cluster", "f.source", F.coalesce("common", "f.own").alias("common"))


def _tokens() -> Column:
    return F.array_sort(F.array_distinct("signature"))


def _holding(items: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, source, item_id) of wide_members(), found over the different signatures; items aren't sent to all tasks."""
    wanted = found.select("cluster", "source", F.size("common").alias("n"), F.explode("common").alias("token"))
    kinds = items.select("item_id", "source", _tokens().alias("tokens"))
    held = kinds.select("source", "tokens").distinct().withColumn("token", F.explode("tokens"))
    shared = wanted.join(held, ["source", "token"]).groupBy("cluster", "source", "tokens", "n").agg(F.count("*").alias("k"))
    whole = shared.where("k = n").select("cluster", "source", "tokens")
    return kinds.join(whole.hint("shuffle_hash"), ["source", "tokens"]).select("cluster", "source", "item_id")


def wide_members(items: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, item_id): items of a leaf's source whose signature holds all its common tokens.

    Tokens are matched and counted, so only pairs that share one are ever formed.
    """
    return _holding(items, found).select("cluster", "item_id")


def memberships(items: DataFrame, threshold: float) -> DataFrame:
    """(cluster, source, item_id) of leaves with their wide members."""
    members, found = leaves(items, threshold)
    return members.select("cluster", "source", "item_id").unionByName(_holding(items, found)).distinct()


def merge_sources(keys: DataFrame, code: str = "github") -> DataFrame:
    """(leaf, parent): leaves of other sources under the code leaf whose keys they share.

    keys has leaf, source, key. The smallest code leaf that shares a key of its
    own claims a leaf; service keys (SVC:) count only for what none has claimed.
    A code leaf that gets any is its own parent's first child. Each key knows its
    smallest code leaf before leaves meet it, so a key of many leaves on both
    sides gives a row a leaf.
    """
    anchors = keys.where(F.col("source") == code).groupBy("key").agg(F.min("leaf").alias("parent"))
    others = keys.where(F.col("source") != code).select("leaf", "key").distinct()
    claim = lambda rows: rows.join(anchors, "key").groupBy("leaf").agg(F.min("parent").alias("parent"))
    sharp = claim(others.where(~F.col("key").startswith("SVC:")))
    rest = claim(others.join(sharp.select("leaf"), "leaf", "left_anti"))
    found = sharp.unionByName(rest)
    return found.unionByName(found.select(F.col("parent").alias("leaf"), "parent").distinct())


def unclassified(items: DataFrame, members: DataFrame, source: str = "jira") -> DataFrame:
    """Eligible items of a source that no cluster holds."""
    return items.where((F.col("source") == source) & F.col("eligible")).join(members.select("item_id").distinct(), "item_id", "left_anti")


def cluster_texts(members: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster, summary): the titles of a cluster's items in order of the items."""
    one = F.struct("item_id", "title")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda o: o["title"])
    return members.join(titles, "item_id").groupBy("cluster").agg(F.array_join(listed, " ").alias("summary"))


def name_votes(items: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(cluster, key, votes): items of a cluster under exactly one namespace; wide items vote for none.

    items has cluster, item_id, folder; namespaces key and prefix.
    """
    hits = items.join(namespaces, F.col("folder") == F.col("prefix")).select("cluster", "item_id", "key").distinct()
    single = hits.groupBy("cluster", "item_id").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    return single.groupBy("cluster", "key").agg(F.count("*").alias("votes"))


def top_votes(votes: DataFrame) -> DataFrame:
    """Each cluster's key of most votes, ties by key."""
    w = Window.partitionBy("cluster").orderBy(F.desc("votes"), "key")
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assign_names(votes: DataFrame) -> list[tuple]:
    """(cluster, key): clusters in order take their best key that is still free.

    A round for each key, never for each cluster; the votes are counted and written once.
    """
    votes = stored(votes.select("cluster", "key", "votes"), "name-votes")
    used: list[str] = []
    out: list[tuple] = []
    while True:
        free = votes.where(~F.col("key").isin(used)) if used else votes
        if out:
            free = free.where(F.col("cluster") > F.lit(out[-1][0]))
        row = free.orderBy("cluster", F.desc("votes"), "key").first()
        if row is None:
            forget(votes)
            return out
        out.append((row["cluster"], row["key"]))
        used.append(row["key"])


def naming_summary(items: DataFrame) -> DataFrame:
    """(cluster, folders, fields): the first few distinct tokens of each kind; items has cluster and token."""
    kind = F.when(F.col("token").startswith("dir:"), "folder").otherwise("field")
    seen = items.select("cluster", "token", kind.alias("kind")).distinct()
    place = F.row_number().over(Window.partitionBy("cluster", "kind").orderBy("token"))
    most = F.when(F.col("kind") == "folder", SUMMARY_FOLDERS).otherwise(SUMMARY_FIELDS)
    few = seen.withColumn("place", place).where(F.col("place") <= most)
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("token"))))
    return few.groupBy("cluster").agg(listed("folder").alias("folders"), listed("field").alias("fields"))


def proposed_names(segments: DataFrame) -> DataFrame:
    """(cluster, name): the most frequent path segment (ties by alphabet) in title case, cut to a name's length."""
    counted = segments.groupBy("cluster", "segment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "segment")
    best = counted.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    words = F.filter(F.split("segment", r"[-_\s]+"), lambda x: x != "")
    shown = F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))), " ")
    return best.select("cluster", F.substring(shown, 1, NAME_LENGTH).alias("name"))


def name_fault(name: Column, taken: Column, banned: tuple[str, ...]) -> Column:
    """Why a name can't be used, null if it can; taken tells whether a sibling has it."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    bad = F.lit(False)
    for word in banned:
        bad = bad | F.lower(clean).contains(word)
    return (
        F.when((clean == "") | (F.length(clean) > NAME_LENGTH), "length")
        .when(F.size(F.filter(F.split(clean, r"\s+"), lambda x: x != "")) > NAME_WORDS, "too many words")
        .when(bad, "banned word")
        .when(taken, "duplicate among siblings")
    )


def name_tree(proposals: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """(node, name, fault): names for nodes (node, name), each name once.

    Nodes take their turn by number. One whose proposal can't be used, or is
    taken by an earlier node, is called after its number, and fault says why. A
    proposal that reads like such a name of another node can't be used either,
    so that no turn depends on more than the first claim to its name.
    """
    clean = F.trim(F.coalesce("name", F.lit("")))
    stand_in = F.concat(F.lit("Capability "), F.col("node").cast("string"))
    fault = name_fault(F.col("name"), F.lit(False), banned)
    fault = F.coalesce(fault, F.when(clean.rlike(r"^Capability -?\d+$") & (clean != stand_in), "name of another"))
    rows = proposals.select("node", F.col("name").alias("_proposed"), clean.alias("_clean"), fault.alias("_fault"))
    first = rows.where("_fault IS NULL").groupBy("_clean").agg(F.min("node").alias("_first"))
    found = rows.join(first, "_clean", "left")
    why = F.coalesce("_fault", F.when(F.col("node") > F.col("_first"), "duplicate among siblings"))
    return found.select("node", F.when(why.isNull(), F.col("_proposed")).otherwise(stand_in).alias("name"), why.alias("fault"))


def reviewed(members: DataFrame, accept: bool) -> DataFrame:
    """Memberships with all that waited for review decided alike."""
    state = F.when(F.col("state") == "pending_review", "approved" if accept else "rejected").otherwise(F.col("state"))
    return members.withColumn("state", state)


def sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n): pairs that reach each threshold, from one table of similarities at the lowest."""
    levels = F.explode(F.array(*map(F.lit, thresholds)))
    return pairs.select("similarity", levels.alias("threshold")).where("similarity >= threshold").groupBy("threshold").agg(F.count("*").alias("n"))
