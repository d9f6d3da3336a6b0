"""Near-duplicate matching, grouping (policy *keep*) and suppression (policy *discard*).

Both policies are defined by a sequence: a picture is compared with what came before it. Equal
hashes are collapsed to one node first, because everything after the first picture of a hash
follows at distance 0; a hash shared by a third of the library then costs one row.

Order values (``ord``) are unique whole numbers; smaller means earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.operators import first_come
from shoebox.operators.hamming_join import candidates
from shoebox.operators.running import last_before
from shoebox.session import durable

LINKS_PER_NODE = 64  # conflicts per hash beyond which clusters are thinned out first
ORD_BITS = 56  # distance and order share one BIGINT, so their minimum is a plain hash aggregate
ORD_ZERO = 1 << (ORD_BITS - 1)  # shifts negative order values into the unsigned range


def _packed(distance, order) -> Column:
    return F.shiftleft(F.col(distance).cast("bigint"), ORD_BITS).bitwiseOR(
        F.col(order) + F.lit(ORD_ZERO)
    )


def _packed_distance(packed) -> Column:
    return F.shiftright(packed, ORD_BITS).cast("int")


def _packed_order(packed) -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << ORD_BITS) - 1)) - F.lit(ORD_ZERO)


def nearest_earlier(
    probe: DataFrame, index: DataFrame, threshold: int = settings.NEAR_THRESHOLD, **options
) -> DataFrame:
    """For each probe node (``bits``, ``ord``) the nearest index node with a smaller ``ord``.

    Returns ``ord``, ``parent`` (order value of the match) and ``distance``; the earliest node
    wins among equal distances; unmatched nodes are absent.
    """
    left = probe.select(F.col("bits").alias("_bits"), F.col("ord").alias("_ord"))
    right = index.select(F.col("bits").alias("_ibits"), F.col("ord").alias("_iord"))
    met = candidates(left, right, "_bits", "_ibits", threshold, **options)
    best = (
        met.where(F.col("_iord") < F.col("_ord"))
        .groupBy(F.col("_ord").alias("ord"))
        .agg(F.min(_packed("distance", "_iord")).alias("_best"))
    )
    return best.select(
        "ord", _packed_order("_best").alias("parent"), _packed_distance("_best").alias("distance")
    )


def match_stored(
    probes: DataFrame, stored: DataFrame, threshold: int = settings.NEAR_THRESHOLD, **options
) -> DataFrame:
    """Match hashes against a fixed set of stored contents.

    ``probes`` has ``bits``; ``stored`` has ``id`` and ``bits``. Among equal distances the hash
    seen first wins; among contents with that hash the last id wins. Returns ``bits``,
    ``content_id``, ``distance``.
    """
    index = stored.groupBy("bits").agg(F.min("id").alias("ord"), F.max("id").alias("content_id"))
    left = probes.select(F.col("bits").alias("_bits")).distinct()
    right = index.select(F.col("bits").alias("_ibits"), F.col("ord").alias("_iord"))
    best = (
        candidates(left, right, "_bits", "_ibits", threshold, **options)
        .groupBy(F.col("_bits").alias("bits"))
        .agg(F.min(_packed("distance", "_iord")).alias("_best"))
        .select("bits", _packed_order("_best").alias("ord"), _packed_distance("_best").alias("distance"))
    )
    return best.join(index.select("ord", "content_id"), "ord").select("bits", "content_id", "distance")


def match_earlier(
    contents: DataFrame, threshold: int = settings.NEAR_THRESHOLD, **options
) -> DataFrame:
    """What each content matches when all of them arrive one by one in ``id`` order.

    ``contents`` has ``id`` and ``bits``. The matched hash is the nearest one seen before; the
    matched content is the last one of that hash that came before. Returns ``id``,
    ``matched_id``, ``distance`` for matched contents.
    """
    contents = durable(contents.select("id", "bits"))
    nodes = durable(contents.groupBy("bits").agg(F.min("id").alias("ord")))
    parents = nearest_earlier(nodes, nodes, threshold, subset=True, **options)
    # Members look up their own hash, first members the matched hash: (hash asked for, asked at).
    members = contents.join(nodes, "bits")
    own = members.where(F.col("id") > F.col("ord")).select(
        "id", F.col("ord").alias("node"), F.lit(0).alias("distance")
    )
    crossed = parents.select(
        F.col("ord").alias("id"), F.col("parent").alias("node"), "distance"
    )
    asked = own.unionByName(crossed)
    known = members.select(
        F.col("ord").alias("node"), (F.col("id") * 2 + 1).alias("_at"), F.col("id").alias("_value")
    )
    questions = asked.select(
        "node", (F.col("id") * 2).alias("_at"), F.lit(None).cast("long").alias("_value"), "id", "distance"
    )
    timeline = known.unionByName(questions, allowMissingColumns=True)
    answered = last_before(timeline, "node", "_at", "_value", "matched_id")
    return answered.where(F.col("id").isNotNull()).select("id", "matched_id", "distance")


def chain_roots(parents: DataFrame) -> DataFrame:
    """Follow ``ord`` -> ``parent`` links to the end of each chain by pointer doubling.

    ``parents`` is a durable table. Rows whose pointer already rests on a root leave the loop; the
    rest shorten their way each round, so a chain of length n takes about log3(n) rounds.
    """
    links = parents.select("ord", F.col("parent").alias("root"), F.lit(True).alias("moving"))
    while not links.where("moving").isEmpty():
        moving = links.where("moving")
        first = links.select(F.col("ord").alias("_o1"), F.col("root").alias("_r1"))
        second = links.select(F.col("ord").alias("_o2"), F.col("root").alias("_r2"))
        hopped = (
            moving.join(first, F.col("root") == F.col("_o1"), "left")
            .join(second, F.col("_r1") == F.col("_o2"), "left")
            .select(
                "ord",
                F.coalesce("_r2", "_r1", "root").alias("root"),
                F.col("_r2").isNotNull().alias("moving"),
            )
        )
        links = durable(links.where("not moving").unionByName(hopped))
    return links.select("ord", "root")


def group_keep(
    stored: DataFrame,
    fresh: DataFrame,
    threshold: int = settings.NEAR_THRESHOLD,
    **options,
) -> DataFrame:
    """Group labels after ``fresh`` contents join ``stored`` ones, every fresh one being kept.

    ``stored`` has ``id``, ``bits``, ``dup_group``; ``fresh`` has ``id``, ``bits`` with ids above
    all stored ids, in order of arrival. Returns ``id``, ``dup_group``, ``near_dup_distance`` for
    every content whose label is set now: members, their roots, and stored contents that were
    matched for the first time.
    """
    rows = durable(
        stored.select("id", "bits", "dup_group", F.lit(False).alias("is_new")).unionByName(
            fresh.select(
                "id", "bits", F.lit(None).cast("long").alias("dup_group"), F.lit(True).alias("is_new")
            )
        )
    )
    old_id = F.when(~F.col("is_new"), F.col("id"))
    nodes = durable(
        rows.groupBy("bits").agg(
            F.min("id").alias("ord"),
            F.max(old_id).alias("stored_rep"),
            F.max_by("dup_group", old_id).alias("rep_group"),
            F.sum(F.col("is_new").cast("int")).alias("n_new"),
        )
    )
    arriving = nodes.where(F.col("stored_rep").isNull())
    parents = durable(nearest_earlier(arriving, nodes, threshold, subset=True, **options))
    roots = chain_roots(parents)
    # The label a root hands down: a stored one its group or its own id, a fresh one its own id.
    label = F.coalesce("rep_group", "stored_rep", "ord")
    labels = nodes.select(F.col("ord").alias("root"), label.alias("label"))
    matched = parents.join(roots, "ord").join(labels, "root").select(
        F.col("ord").alias("_ord"), "label", "distance"
    )
    has_child = parents.select(F.col("parent").alias("_parent")).distinct()
    node_state = (
        nodes.join(matched, F.col("ord") == F.col("_ord"), "left")
        .join(has_child, F.col("ord") == F.col("_parent"), "left")
        .select(
            "bits",
            "ord",
            "stored_rep",
            "rep_group",
            F.coalesce(F.col("label"), label).alias("label"),
            "distance",
            (F.col("_parent").isNotNull() | (F.col("n_new") > F.col("stored_rep").isNull().cast("int"))).alias(
                "is_matched"
            ),
        )
    )
    members = rows.where("is_new").select("id", "bits").join(node_state, "bits")
    first = F.col("stored_rep").isNull() & (F.col("id") == F.col("ord"))
    alone = first & F.col("distance").isNull() & ~F.col("is_matched")
    new_labels = members.where(~alone).select(
        "id",
        F.col("label").alias("dup_group"),
        F.when(first, F.col("distance")).otherwise(F.lit(0)).alias("near_dup_distance"),
    )
    newly_matched = node_state.where(
        F.col("stored_rep").isNotNull() & F.col("rep_group").isNull() & F.col("is_matched")
    ).select(
        F.col("stored_rep").alias("id"),
        F.col("stored_rep").alias("dup_group"),
        F.lit(None).cast("int").alias("near_dup_distance"),
    )
    return new_labels.unionByName(newly_matched)


def keep_in_order(
    stored: DataFrame,
    fresh: DataFrame,
    threshold: int = settings.NEAR_THRESHOLD,
    task_edges: int = first_come.TASK_EDGES,
    **options,
) -> DataFrame:
    """Hashes that survive policy *discard*: the greedy choice in order of arrival.

    ``stored`` has ``bits``, ``ord`` (kept by definition, smaller than all fresh order values);
    ``fresh`` has ``bits``, ``ord``; both one row per hash, without a common hash. What is near a
    stored hash goes first. The conflicts of the rest are listed once and settled by components.
    Before that, while they are many more than the hashes (a dense cluster), the hashes without an
    earlier neighbour are kept and all their neighbours dropped. Returns kept fresh rows (``bits``, ``ord``).
    """
    nodes = fresh.select("bits", "ord")
    if not stored.isEmpty():
        near = candidates(*_sides(fresh, stored), "_bits", "_ibits", threshold, **options)
        nodes = nodes.join(near.select(F.col("_ord").alias("ord")).distinct(), "ord", "left_anti")
    nodes = durable(nodes)
    settled: list[DataFrame] = []
    while count := nodes.count():
        later = candidates(*_sides(nodes, nodes), "_bits", "_ibits", threshold, **{"rows": count, **options}, subset=True)
        waiting = durable(
            later.where(F.col("_iord") < F.col("_ord")).groupBy(F.col("_ord").alias("ord")).agg(F.count("*").alias("_links"))
        )
        links = waiting.agg(F.sum("_links")).first()[0] or 0
        if not links:
            settled.append(nodes)
            break
        asking = nodes.join(waiting.select("ord"), "ord", "left_semi")
        if links <= max(LINKS_PER_NODE * count, task_edges):
            pairs = candidates(*_sides(asking, nodes), "_bits", "_ibits", threshold, **{"rows": count, **options})
            edges = pairs.where(F.col("_iord") < F.col("_ord")).select(F.col("_ord").alias("later"), F.col("_iord").alias("earlier"))
            dropped = first_come.dropped_nodes(durable(edges.distinct()), task_edges)
            settled.append(nodes.join(dropped, "ord", "left_anti").select("bits", "ord"))
            break
        roots = durable(nodes.join(waiting.select("ord"), "ord", "left_anti").select("bits", "ord"))
        settled.append(roots)
        hit = candidates(*_sides(asking, roots), "_bits", "_ibits", threshold, **options)
        nodes = durable(asking.join(hit.select(F.col("_ord").alias("ord")).distinct(), "ord", "left_anti").select("bits", "ord"))
    kept = settled[0] if settled else nodes
    for more in settled[1:]:
        kept = kept.unionByName(more)
    return kept


def _sides(probe: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        probe.select(F.col("bits").alias("_bits"), F.col("ord").alias("_ord")),
        index.select(F.col("bits").alias("_ibits"), F.col("ord").alias("_iord")),
    )


def assign_similar(
    files: DataFrame, kept: DataFrame, threshold: int = settings.NEAR_THRESHOLD, **options
) -> DataFrame:
    """Link files of dropped pictures to the nearest picture kept before that very file.

    ``files`` has ``ord`` and ``bits``; ``kept`` has ``bits``, ``ord``, ``content_id`` with one
    row per hash. Only the earliest kept hash per distance can win, so a hash carries at most
    ``threshold + 1`` rows to its files. Returns ``ord``, ``content_id``, ``distance``.
    """
    asked = files.select(F.col("bits").alias("_bits")).distinct()
    index = kept.select(F.col("bits").alias("_ibits"), F.col("ord").alias("_iord"))
    steps = (
        candidates(asked, index, "_bits", "_ibits", threshold, **options)
        .groupBy(F.col("_bits").alias("bits"), "distance")
        .agg(F.min("_iord").alias("_iord"))
    )
    best = (
        files.select("ord", "bits")
        .join(steps, "bits")
        .where(F.col("_iord") < F.col("ord"))
        .groupBy("ord")
        .agg(F.min(_packed("distance", "_iord")).alias("_best"))
        .select("ord", _packed_order("_best").alias("_kept"), _packed_distance("_best").alias("distance"))
    )
    owners = kept.select(F.col("ord").alias("_kept"), "content_id")
    return best.join(owners, "_kept").select("ord", "content_id", "distance")
