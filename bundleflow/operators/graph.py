"""The property graph as tables: one node table per label, one edge table per relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_id
from ..session import cut_lineage
from .merge import merge_nodes
from .validate import check_unique
from .vectors import top_per_group

HUB = 1000  # documents of an entity beyond which it is counted through sets of hubs

NODE_KEYS = {
    "Document": ("document_id",),
    "Page": ("page_id",),
    "Person": ("person_key",),
    "Entity": ("type", "value"),
    "Organization": ("name",),
    "Vendor": ("name",),
}


def person_key(df: DataFrame) -> DataFrame:
    """Registration number where known, else name and birth date."""
    fallback = F.concat_ws("|", F.lower("full_name"), F.col("dob").cast("string"))
    return df.withColumn("person_key", F.coalesce(F.col("registration_no").cast("string"), fallback))


def graph_nodes(
    documents: DataFrame, pages: DataFrame, persons: DataFrame, entities: DataFrame
) -> dict[str, DataFrame]:
    """Node tables, one row per natural key."""
    metadata = F.col("metadata") if "metadata" in documents.columns else F.lit(None).cast("string")

    def from_metadata(path: str) -> DataFrame:
        return documents.select(F.get_json_object(metadata, path).alias("name")).filter(F.col("name").isNotNull()).distinct()

    return {
        "Document": merge_nodes(["document_id"], documents.select("document_id", "document_category")),
        "Page": merge_nodes(
            ["page_id"],
            pages.select(page_id(F.col("document_id"), F.col("page_num")).alias("page_id"), "page_num", "page_type"),
        ),
        "Person": merge_nodes(["person_key"], person_key(persons).select("person_key", "full_name", "dob")),
        "Entity": entities.select("type", "value").distinct(),
        "Organization": from_metadata("$.sender_org"),
        "Vendor": from_metadata("$.vendor_name"),
    }


def graph_edges(
    pages: DataFrame, entities: DataFrame, belongs_to: DataFrame, matches: DataFrame
) -> dict[str, DataFrame]:
    """Edge tables on natural keys.  BELONGS_TO is stored once and joined either way."""
    return {
        "HAS_PAGE": pages.select(
            "document_id", page_id(F.col("document_id"), F.col("page_num")).alias("page_id")
        ).distinct(),
        "MENTIONS": entities.select(
            page_id(F.col("document_id"), F.col("page_num")).alias("page_id"), "type", "value"
        ).distinct(),
        "BELONGS_TO": belongs_to.select("document_id", "person_key").distinct(),
        "MATCHES": matches.filter(F.col("reference_data_id").isNotNull()).select("document_id", "reference_data_id").distinct(),
    }


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) per table; each table is counted where it lies."""
    return reduce(
        DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, t in tables.items()]
    )


def graph_constraints(nodes: dict[str, DataFrame]) -> DataFrame:
    """(label, violations): natural keys occurring more than once, per constrained label."""
    parts = [
        check_unique(nodes[label], list(NODE_KEYS[label])).agg(F.count("*").alias("violations")).select(
            F.lit(label).alias("label"), "violations"
        )
        for label in ("Document", "Page", "Person")
    ]
    return reduce(DataFrame.unionByName, parts)


def entity_lookup(mentions: DataFrame, kind: str, value: str) -> DataFrame:
    """Pages that mention one entity; both tests reach the file scan."""
    return mentions.filter((F.col("type") == kind) & (F.col("value") == value)).select("page_id")


def documents_of_person(persons: DataFrame, belongs_to: DataFrame, name: str, dob: str) -> DataFrame:
    """Documents of the person with this name and birth date."""
    wanted = persons.filter((F.lower("full_name") == name.lower()) & (F.col("dob") == F.lit(dob).cast("date")))
    return belongs_to.join(wanted.select("registration_no"), "registration_no", "left_semi").select("document_id").distinct()


def graph_walk(persons: DataFrame, belongs_to: DataFrame, pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Person -> Document -> Page -> Entity, one row per path."""
    return (
        persons.select("registration_no", "full_name")
        .join(belongs_to.select("registration_no", "document_id"), "registration_no")
        .join(pages.select("document_id", "page_num"), "document_id")
        .join(mentions.select("document_id", "page_num", "type", "value"), ["document_id", "page_num"])
    )


def name_variants(persons: DataFrame, key: str, name: str) -> DataFrame:
    """(key, variant, n): distinct spellings per person in long form, so none is dropped and no
    person's spellings have to fit one array."""
    return persons.groupBy(key, F.lower(F.trim(F.col(name))).alias("variant")).agg(F.count("*").alias("n"))


def co_mentions(mentions: DataFrame) -> DataFrame:
    """Two-hop neighbourhood document -> entity -> document, summarised per document.

    (document_id, entities, shared_entities, links, hub_document): ``links`` counts the other
    documents met over all shared entities; ``hub_document`` is the smallest document id met.
    Documents that share an entity have the same hub through it, so the star of
    (document, hub) edges keeps who is linked with whom without listing every pair of a group.
    """
    pairs = mentions.select("document_id", "type", "value").distinct()
    spread = pairs.groupBy("type", "value").agg(F.count("*").alias("_df"), F.min("document_id").alias("_hub"))
    joined = pairs.join(spread, ["type", "value"])
    return joined.groupBy("document_id").agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("_df") > 1).alias("shared_entities"),
        F.sum(F.col("_df") - 1).alias("links"),
        F.min("_hub").alias("hub_document"),
    )


def co_mentioned_with(mentions: DataFrame, document_id: str) -> DataFrame:
    """Documents that share an entity with one document, with the number of shared entities."""
    seed = mentions.filter(F.col("document_id") == document_id).select("type", "value").distinct()
    others = mentions.filter(F.col("document_id") != document_id).select("document_id", "type", "value").distinct()
    return others.join(seed, ["type", "value"], "left_semi").groupBy("document_id").agg(F.count("*").alias("shared"))


def co_mentioned_top(mentions: DataFrame, seeds: DataFrame, k: int = 10, hub: int = HUB) -> DataFrame:
    """The k documents that share most entities with each seed: (document_id, partner, shared, rank).

    mentions: (document_id, type, value), repeats allowed; seeds: (document_id).  ``shared`` counts
    distinct entities; ties go to the smaller document.  Seeds that share nothing have no rows.

    Entities of at most ``hub`` documents are walked one by one.  The others, the hubs, would list
    a group's pairs; what counts there is only which hubs a document has, so documents are folded
    into sets of hubs, sets are counted against sets, and of each set k + 1 documents can come
    first.  A partner met through a rare entity adds what the two sets share.  The result does not
    depend on ``hub``.
    """
    whole = mentions.filter("document_id IS NOT NULL AND type IS NOT NULL AND value IS NOT NULL").select("document_id", "type", "value").distinct()
    degree = whole.groupBy("type", "value").agg(F.count("*").alias("_n"))
    pairs = cut_lineage(whole.join(degree, ["type", "value"]))
    asked = seeds.select("document_id").filter("document_id IS NOT NULL").distinct()

    light = pairs.filter(F.col("_n") <= hub).drop("_n")
    ours = light.join(asked, "document_id", "left_semi").withColumnRenamed("document_id", "_seed")
    walked = ours.join(light, ["type", "value"]).filter("_seed <> document_id").groupBy("_seed", "document_id").agg(F.count("*").alias("_light"))

    sets = pairs.filter(F.col("_n") > hub).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("_hubs"))
    # half a digest as bytes: pairs carry the names of two sets through their shuffles
    sets = cut_lineage(sets.withColumn("_set", F.unhex(F.substring(F.sha2(F.to_json("_hubs"), 256), 1, 32))))
    members = top_per_group(sets.select("_set", "document_id"), ["_set"], k + 1, [F.asc("document_id")])
    members = members.select("_set", F.col("document_id").alias("partner"))
    seed_sets = sets.join(asked, "document_id", "left_semi").select(F.col("document_id").alias("_seed"), F.col("_set").alias("_own"))

    about = sets.groupBy("_set").agg(F.any_value("_hubs").alias("_hubs"), F.min("document_id").alias("_first"))
    listed = about.select("_set", "_first", F.inline("_hubs"))
    own = listed.join(seed_sets.select(F.col("_own").alias("_set")).distinct(), "_set", "left_semi").select(F.col("_set").alias("_own"), "type", "value")
    shared = own.join(listed, ["type", "value"]).groupBy("_own", "_set").agg(F.count("*").alias("_heavy"), F.any_value("_first").alias("_first"))
    shared = cut_lineage(shared)
    near = top_per_group(shared, ["_own"], k + 1, [F.desc("_heavy"), F.asc("_first")]).select("_own", "_set", "_heavy")
    near = top_per_group(near.join(members, "_set"), ["_own"], k + 1, [F.desc("_heavy"), F.asc("partner")]).select("_own", "partner", "_heavy")
    by_hubs = seed_sets.join(near, "_own").filter("_seed <> partner").select("_seed", "partner", F.col("_heavy").alias("shared"))

    theirs = sets.select("document_id", "_set")
    both = walked.join(seed_sets, "_seed", "left").join(theirs, "document_id", "left").join(shared.drop("_first"), ["_own", "_set"], "left")
    by_light = both.select("_seed", F.col("document_id").alias("partner"), (F.col("_light") + F.coalesce("_heavy", F.lit(0))).alias("shared"))
    best = by_light.unionByName(by_hubs).groupBy("_seed", "partner").agg(F.max("shared").alias("shared"))
    ranked = top_per_group(best, ["_seed"], k, [F.desc("shared"), F.asc("partner")])
    return ranked.select(F.col("_seed").alias("document_id"), "partner", "shared", F.col("rank").cast("int").alias("rank"))


CONTRACTIONS = 3  # rounds that shrink the graph before the stars; they change the work, never the result


def entity_clusters(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, cluster), the cluster named by its smallest node.

    Edges are read once.  First the graph is contracted: each node goes over to the neighbour, or
    itself, that comes first in an order drawn for the round, and those that meet become one node
    under the smallest of their names.  On what is left, large-star and small-star alternate: every
    round relinks each node to the smallest neighbour it has seen, so path lengths shrink
    geometrically and the edge count never grows; it ends at the fixed point.  A hub is reduced to
    its minimum map-side, and the join back to its edges is one AQE can split.  Each round is
    checkpointed: lineage stays short and a lost executor costs one round.
    """
    u, v = F.col("u"), F.col("v")
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = cut_lineage(both.select(F.when(u < v, v).otherwise(u).alias("u"), F.when(u < v, u).otherwise(v).alias("v")).distinct())
    alone = links.select(F.lit(None).cast(links.schema["u"].dataType).alias("node")).filter("u IS NULL OR v IS NULL").distinct()
    links = links.select(F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")).filter("u IS NOT NULL")

    rounds: list[DataFrame] = []
    for level in range(CONTRACTIONS):
        rounds.append(cut_lineage(_renamed(links, level)))
        links = cut_lineage(_contracted(links, rounds[-1]))
    signature = _signature(links)
    while signature[0]:
        links = cut_lineage(_small_star(_large_star(links)))
        after = _signature(links)
        if after == signature:
            break
        signature = after
    found = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("cluster"))
    for names in reversed(rounds):
        found = names.join(found.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("cluster", "name").alias("cluster"))
    return found.unionByName(alone.withColumn("cluster", F.col("node")))


def _renamed(links: DataFrame, level: int) -> DataFrame:
    """(node, name) for every node of the links: the smallest node among those that go over to the same one."""

    def placed(node: str):
        return F.struct(F.xxhash64(F.lit(level), node).alias("place"), F.col(node).alias("node"))

    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))))
    first = ends.groupBy("node").agg(F.min(placed("other")).alias("_first"))
    moves = first.select("node", F.least("_first", placed("node"))["node"].alias("_to"))
    return moves.join(moves.groupBy("_to").agg(F.min("node").alias("name")), "_to").select("node", "name")


def _contracted(links: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct links between the new names, loops dropped."""
    ours, theirs = (names.select(F.col("node").alias(c), F.col("name").alias(f"_{c}")) for c in ("u", "v"))
    moved = links.filter(F.col("u") != F.col("v")).join(ours, "u").select("_u", "v").distinct().join(theirs, "v")
    return _oriented(moved.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def _oriented(df: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, self loops dropped."""
    return df.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    sym = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _oriented(sym.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.union(low.select("u", F.col("m").alias("v"))))


def _signature(links: DataFrame) -> tuple[int, int]:
    """Count and an order-free hash of the edge set, to detect the fixed point."""
    row = links.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return int(row["n"]), int(row["h"])
