"""Graphs in normal form: canonical node identifiers, order, and a hash.

Nodes are (node, node_type, is_entity, payload), edges (edge_type, src, dst,
payload); payloads are canonical JSON texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.canonical import base64url, hash_text, json_quote


def canonical_ids(nodes: DataFrame, edges: DataFrame, prefix: str = "node:") -> DataFrame:
    """(node, node_id): an entity keeps its identifier; another node has the
    hash of its type, payload and sorted incident edges. Neighbours that aren't
    entities are told apart by their own summary, without edges."""
    own = hash_text(F.concat_ws("|", "node_type", F.coalesce("payload", F.lit("{}"))))
    first = nodes.select("node", F.when(F.col("is_entity"), F.col("node")).otherwise(own).alias("label"))
    out = edges.select(F.col("src").alias("node"), "edge_type", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    both = out.union(edges.select(F.col("dst").alias("node"), "edge_type", F.lit("in").alias("direction"), F.col("src").alias("other")))
    both = both.join(first.select(F.col("node").alias("other"), "label"), "other")
    inc = both.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("edge_type", "direction", "label"))).alias("inc"))
    items = F.array_join(F.transform(F.coalesce("inc", F.expr("cast(array() as array<struct<edge_type:string,direction:string,label:string>>)")), lambda e: F.concat_ws("|", e["edge_type"], e["direction"], e["label"])), ",")
    summary = F.concat(F.lit('{"incidentEdges":['), items, F.lit('],"nodeType":'), json_quote("node_type"), F.lit(',"payload":'), F.coalesce("payload", F.lit("{}")), F.lit("}"))
    return nodes.join(inc, "node", "left").select("node", F.when(F.col("is_entity"), F.col("node")).otherwise(F.concat(F.lit(prefix), base64url(hash_text(summary)))).alias("node_id"))


def normal_form(nodes: DataFrame, edges: DataFrame, prefix: str = "node:") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_type, node_id, payload) and edges (edge_type, src, dst,
    payload) with canonical identifiers; in any order of rows, as a set."""
    ids = canonical_ids(nodes, edges, prefix)
    n = nodes.join(ids, "node").select("node_type", "node_id", F.coalesce("payload", F.lit("{}")).alias("payload"))
    e = edges.join(ids.select(F.col("node").alias("src"), F.col("node_id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("node_id").alias("d")), "dst")
    return n, e.select("edge_type", F.col("s").alias("src"), F.col("d").alias("dst"), F.coalesce("payload", F.lit("{}")).alias("payload"))


def graph_hash(nodes: DataFrame, edges: DataFrame, prefix: str = "graph:") -> DataFrame:
    """(n_nodes, n_edges, graph_hash, graph_tag) of a normal form. Rows are
    hashed where they are; the sorted hashes are hashed in two levels, by their
    first two hex digits, so no task holds the graph."""
    rows = nodes.select(F.lit("n").alias("k"), hash_text(F.concat_ws("|", "node_type", "node_id", "payload")).alias("h")).union(
        edges.select(F.lit("e").alias("k"), hash_text(F.concat_ws("|", "edge_type", "src", "dst", "payload")).alias("h")))
    part = rows.groupBy("k", F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), hash_text(F.array_join(F.array_sort(F.collect_list("h")), ",")).alias("h"))
    g = part.agg(F.coalesce(F.sum(F.when(F.col("k") == "n", F.col("n"))), F.lit(0)).cast("long").alias("n_nodes"), F.coalesce(F.sum(F.when(F.col("k") == "e", F.col("n"))), F.lit(0)).cast("long").alias("n_edges"), F.array_sort(F.collect_list(F.concat_ws(":", "k", "p", "h"))).alias("hs"))
    g = g.withColumn("graph_hash", hash_text(F.array_join("hs", ",")))
    return g.select("n_nodes", "n_edges", "graph_hash", F.concat(F.lit(prefix), base64url("graph_hash")).alias("graph_tag"))
