"""Identity resolution by rules: blocks, evidence, conflicts, clusters.

Inputs are entities (entity_id, name, jurisdiction, entity_type, country) and
identifiers (entity_id, scheme, value). Pairs come from equi-joins on blocking
keys. Merges within a block are written as links to the block's least member, so
a block costs as many links as it has members; pairs are only listed for those
who ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.functions.canonical import base64url, hash_text
from rollcall.session import checkpointed

STRONG = ("lei", "uei", "hash", "bn")


def blocks(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(kind, key, entity_id): one row per entity and blocking key."""
    by_name = entities.where("name <> '' and jurisdiction is not null").select(F.lit("name").alias("kind"), F.concat_ws("|", "name", "jurisdiction").alias("key"), "entity_id")
    by_id = identifiers.where("value <> ''").select(F.lit("identifier").alias("kind"), F.concat_ws(":", "scheme", "value").alias("key"), "entity_id")
    return by_name.unionByName(by_id).distinct()


def candidate_pairs(found: DataFrame) -> DataFrame:
    """(a, b, kinds): every unordered pair of a block, once. Quadratic in the
    size of a block, as the listing is; ``merge_links`` does with fewer."""
    a, b = found.select("kind", "key", F.col("entity_id").alias("a")), found.select("kind", "key", F.col("entity_id").alias("b"))
    return a.join(b, ["kind", "key"]).where("a < b").groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def evidence(pairs: DataFrame, entities: DataFrame, identifiers: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """Pairs with ``rule`` and ``decision`` (merge, conflict, separate).

    1 fingerprint: equal hashes. 4 conflict: a strong identifier agrees but the
    country differs, or another strong scheme contradicts. 2 strong identifier.
    3 moderate: name, jurisdiction and type agree and no identifier contradicts.
    5 none of these.
    """
    e = entities.select("entity_id", "name", "jurisdiction", "entity_type", "country")
    side = lambda s: e.select(*[F.col(c).alias(s if c == "entity_id" else f"{s}_{c}") for c in e.columns])
    i = identifiers.where(F.col("scheme").isin(list(strong)))
    ia, ib = i.select(F.col("entity_id").alias("a"), "scheme", F.col("value").alias("va")), i.select(F.col("entity_id").alias("b"), "scheme", F.col("value").alias("vb"))
    per = pairs.select("a", "b").join(ia, "a").join(ib, ["b", "scheme"]).groupBy("a", "b", "scheme").agg(F.bool_or(F.col("va") == F.col("vb")).alias("same"))
    per = per.groupBy("a", "b").agg(F.bool_or(F.col("same") & (F.col("scheme") == "hash")).alias("same_hash"), F.bool_or("same").alias("agrees"), F.bool_or(~F.col("same")).alias("contradicts"))
    x = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").join(per, ["a", "b"], "left").na.fill(False, ["same_hash", "agrees", "contradicts"])
    alike = (F.col("a_name") == F.col("b_name")) & (F.col("a_jurisdiction") == F.col("b_jurisdiction")) & F.col("a_entity_type").eqNullSafe(F.col("b_entity_type"))
    odd = F.col("contradicts") | (F.col("a_country") != F.col("b_country"))
    rule = F.when(F.col("same_hash"), 1).when(F.col("agrees") & odd, 4).when(F.col("agrees"), 2).when(alike & ~F.col("contradicts"), 3).otherwise(5)
    return x.select("a", "b", rule.alias("rule"), F.when(rule.isin(1, 2, 3), "merge").when(rule == 4, "conflict").otherwise("separate").alias("decision"))


def conflicts(decided: DataFrame) -> DataFrame:
    return decided.where("decision = 'conflict'").select(F.lit("IdentifierConflict").alias("conflict_type"), F.concat_ws(",", "a", "b").alias("entities"), F.lit("unresolved").alias("resolution_status"))


def block_links(found: DataFrame) -> DataFrame:
    """(a, b): each member of a block with its least member."""
    least = F.min("entity_id").over(W.partitionBy("kind", "key"))
    return found.withColumn("a", least).where("a < entity_id").select("a", F.col("entity_id").alias("b")).distinct()


def signatures(entities: DataFrame, identifiers: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """``entities`` with ``ids`` (sorted strong identifiers) and ``least``, the least
    entity of those that no rule can tell apart and every rule merges: equal in
    name, jurisdiction, type, country and identifiers, with either identifiers
    (one a scheme) or a name and jurisdiction. Others are their own."""
    i = identifiers.where(F.col("scheme").isin(list(strong)) & (F.col("value") != "")).select("entity_id", F.struct("scheme", "value").alias("i")).distinct()
    held = i.groupBy("entity_id").agg(F.array_sort(F.collect_set("i")).alias("ids"), F.countDistinct("i.scheme").alias("schemes"))
    e = entities.join(held, "entity_id", "left").withColumn("schemes", F.coalesce("schemes", F.lit(0)))
    named = F.coalesce((F.col("name") != "") & F.col("jurisdiction").isNotNull(), F.lit(False))
    alike = F.when(F.col("schemes") > 0, F.col("schemes") == F.size("ids")).otherwise(named)
    text = F.to_json(F.struct("name", "jurisdiction", "entity_type", "country", "ids"), {"ignoreNullFields": "false"})
    e = e.withColumn("sign", F.when(alike, F.sha2(text, 256)).otherwise(F.concat(F.lit("own:"), F.col("entity_id").cast("string"))))
    least = e.groupBy("sign").agg(F.min("entity_id").alias("least"))
    return e.join(least, "sign").drop("sign", "schemes")


def merge_links(entities: DataFrame, identifiers: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """Links (a, b) with the same components as all merged pairs have. Entities
    that can't be told apart are linked to their least one, and only the least
    ones are paired: a block of n such entities costs n links, and one with s
    different ones s * s / 2 pairs."""
    e = checkpointed(signatures(entities, identifiers, strong))
    stars = e.where("least < entity_id").select(F.col("least").alias("a"), F.col("entity_id").alias("b"))
    few = e.where("least = entity_id").select("entity_id", "name", "jurisdiction", "entity_type", "country")
    ids = identifiers.join(few.select("entity_id"), "entity_id", "left_semi")
    pairs = evidence(candidate_pairs(blocks(few, ids)), few, ids, strong)
    return stars.union(pairs.where("decision = 'merge'").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected (a, b) edges; a component is
    named by its least node. Hooks to the least neighbour and jumps pointers, so
    the rounds grow with the logarithm of the diameter; each is checkpointed in
    the shared folder."""
    e = edges.select("a", "b").where("a <> b")
    e = checkpointed(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = e.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "m").alias("c"))
        # What a root's members have found is the root's too.
        root = hooked.groupBy("component").agg(F.min("c").alias("r"))
        moved = hooked.join(root, "component").select("node", F.col("component").alias("was"), F.least("c", "r").alias("c"))
        up = moved.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = checkpointed(moved.join(up, "c").select("node", "was", F.least("c", "cc").alias("component")))
        done = new.where("was <> component").isEmpty()
        label = new.select("node", "component")
        if done:
            return label


def clusters(entities: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity_id, cluster): the transitive closure of merges; entities in none
    are their own cluster."""
    found = components(merged).select(F.col("node").alias("entity_id"), F.col("component").alias("cluster"))
    return entities.select("entity_id").join(found, "entity_id", "left").withColumn("cluster", F.coalesce("cluster", "entity_id"))


def cluster_ids(assigned: DataFrame, version: str = "1.0.0", prefix: str = "entity-cluster:") -> DataFrame:
    """(cluster, cluster_id, n_members): an identifier from the hash of the
    sorted members and the version."""
    g = assigned.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("entity_id").cast("string"))).alias("m"))
    text = F.concat(F.lit('{"members":["'), F.array_join("m", '","'), F.lit('"],"version":"' + version + '"}'))
    return g.select("cluster", F.concat(F.lit(prefix), base64url(hash_text(text))).alias("cluster_id"), F.size("m").alias("n_members"))
