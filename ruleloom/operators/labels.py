"""Statistics of labellings and registries: coverage, nesting, agreement, enrichment, refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partition import spread


def leaves(registry: DataFrame) -> DataFrame:
    """Registry rows that are no one's parent."""
    return registry.join(registry.select(F.col("parent").alias("key")).where("key is not null").distinct(), "key", "left_anti")


def registry_problems(registry: DataFrame, low: int = 12, high: int = 20) -> DataFrame:
    """check, subject: repeated keys and definitions, missing fields, unknown parents, more than two levels, roots out of band."""
    up = registry.alias("a").join(registry.select(F.col("key").alias("k1"), F.col("parent").alias("p1"), F.lit(True).alias("found")), F.col("parent") == F.col("k1"), "left")
    roots = registry.where("parent is null").agg(F.count("*").alias("n")).where(~F.col("n").between(low, high))
    checks = [
        registry.groupBy("key").count().where("count > 1").select(F.lit("repeated key").alias("check"), F.col("key").alias("subject")),
        registry.groupBy("definition").count().where("count > 1 and definition is not null").select(F.lit("repeated definition").alias("check"), F.col("definition").alias("subject")),
        registry.where("coalesce(title, '') = '' or coalesce(definition, '') = '' or size(coalesce(seed_anchors, array())) = 0").select(F.lit("missing field").alias("check"), F.col("key").alias("subject")),
        up.where("parent is not null and found is null").select(F.lit("unknown parent").alias("check"), F.col("key").alias("subject")),
        up.where("p1 is not null").select(F.lit("depth").alias("check"), F.col("key").alias("subject")),
        roots.select(F.lit("roots").alias("check"), F.col("n").cast("string").alias("subject")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def span(registry: DataFrame, chapters: DataFrame, least: int = 2) -> DataFrame:
    """key, chapters, ok: roots whose seeds lie in at least two chapters."""
    seeds = registry.where("parent is null").select("key", F.explode_outer("seed_anchors").alias("slug"))
    n = seeds.join(chapters.select("slug", "chapter"), "slug", "left").groupBy("key").agg(F.countDistinct("chapter").alias("chapters"))
    return n.withColumn("ok", F.col("chapters") >= least)


def coextensive(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """label, gid: labels whose rules are exactly a group's members."""
    sets = labels.groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("members"))
    return sets.join(groups.select("gid", F.array_sort("members").alias("members")), "members").select("label", "gid")


def nesting(labels: DataFrame) -> DataFrame:
    """a, b, kind: labels with equal rules (duplicate, a < b), and labels whose rules another has with more (nested, a inside b)."""
    size = labels.groupBy("label").agg(F.countDistinct("id").alias("n"))
    both = labels.select("id", F.col("label").alias("a")).join(labels.select("id", F.col("label").alias("b")), "id").where("a <> b").groupBy("a", "b").agg(F.countDistinct("id").alias("both"))
    df = both.join(size.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    kind = F.when((F.col("both") == F.col("na")) & (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")), "duplicate").when((F.col("both") == F.col("na")) & (F.col("na") < F.col("nb")), "nested")
    return df.withColumn("kind", kind).where("kind is not null").select("a", "b", "kind")


def residue(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """id of rules without a label."""
    return rules.select("id").join(labels, "id", "left_anti")


def coverage(rules: DataFrame, labels: DataFrame, floor: int = 3) -> DataFrame:
    """One row: rules, unlabelled, fewest and most labels of a rule, and how many labels have fewer rules than the floor."""
    per = rules.select("id").join(labels.groupBy("id").agg(F.countDistinct("label").alias("n")), "id", "left").agg(F.count("*").alias("rules"), F.count_if(F.col("n").isNull()).alias("unlabelled"), F.min(F.coalesce("n", F.lit(0))).alias("fewest"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    thin = labels.groupBy("label").agg(F.countDistinct("id").alias("n")).agg(F.count_if(F.col("n") < floor).alias("thin"))
    return per.crossJoin(thin)


def enrichment(labels: DataFrame, rules: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: base, the share of all pairs of rules with a label in common; observed, that of linked pairs (a < b); ratio."""
    held = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("set"))
    # rules with one set of labels count as often as they are; different sets meet by label
    sets = held.groupBy("set").agg(F.count("*").alias("n"))
    each = sets.select("set", "n", F.explode("set").alias("label"))
    met = each.join(each.select(F.col("set").alias("other"), F.col("n").alias("m"), "label"), "label").where("set < other").select("set", "other", "n", "m").distinct()
    alike = sets.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("p")).unionByName(met.select((F.col("n") * F.col("m")).alias("p")))
    n = rules.agg(F.countDistinct("id").alias("rules"))
    pair = linked.select("a", "b").distinct()
    of = lambda x: held.select(F.col("id").alias(x), F.col("set").alias(f"of_{x}"))
    both = pair.join(of("a"), "a", "left").join(of("b"), "b", "left")
    hit = both.agg(F.count("*").alias("linked"), F.count_if(F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False))).alias("hits"))
    df = alike.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("sharing")).crossJoin(n).crossJoin(hit)
    df = df.withColumn("base", F.try_divide(F.col("sharing"), F.col("rules") * (F.col("rules") - 1) / 2)).withColumn("observed", F.try_divide(F.col("hits"), F.col("linked")))
    return df.withColumn("ratio", F.try_divide("observed", "base"))


#: Permutations that one digest orders (32 bits each), and tasks that the permutations of one whole set of rules are dealt to.
_OF_DIGEST, _TASKS = 4, 25


def permutation_p(labels: DataFrame, linked: DataFrame, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """One row: observed hits, at_least (permutations with as many), p = (at_least + 1) / (permutations + 1).

    The label sets are dealt anew to the ids (those with a label) in every permutation; the permutations are dealt to tasks."""
    one = lambda df: df.withColumn("__all", F.lit(""))
    return permutation_p_within(one(labels), one(linked), "__all", permutations, seed, _TASKS)


def drawn(ids: list[str], first: int, many: int, seed: int) -> np.ndarray:
    """Permutations `first` and following as rows of places: the sorted ids in the order of 32 bits of md5(seed:block:id), ties by id.

    Permutation k takes the (k mod 4)th 32 bits of block k div 4, so that it is named by seed, number and id alone."""
    words = [x.encode() for x in ids]
    out = []
    for block in range(first // _OF_DIGEST, -(-(first + many) // _OF_DIGEST)):
        head = hashlib.md5(f"{seed}:{block}:".encode())
        digests = []
        for w in words:
            h = head.copy()
            h.update(w)
            digests.append(h.digest())
        keys = np.frombuffer(b"".join(digests), ">u4").reshape(len(words), _OF_DIGEST)
        out.append(np.argsort(keys, axis=0, kind="stable").T)
    skip = first % _OF_DIGEST
    return np.concatenate(out)[skip : skip + many]


def permutation_p_within(labels: DataFrame, linked: DataFrame, group: str, permutations: int = 1000, seed: int = 0, tasks: int = 1) -> DataFrame:
    """permutation_p where label sets are dealt anew within each group only, as where labels are a document's own.

    labels: group, id, label (null for an id without one, which is dealt too); linked: group, a, b. Permutations are those of drawn(),
    so the result doesn't depend on how rows lie. Work is permutations x (rules + pairs) in arrays; a group's
    permutations are dealt to so many tasks, and a task returns one row."""
    sets = labels.groupBy(group).agg(F.collect_set("id").alias("ids"), F.collect_set(F.when(F.col("label").isNotNull(), F.struct("id", "label"))).alias("has"))
    pairs = linked.groupBy(group).agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    rows = sets.join(pairs, group).select("ids", "has", "pairs", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
    rows = spread(rows.withColumn("__h", F.xxhash64("ids")), "part", "__h").drop("__h")
    share = -(-permutations // tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, observed = np.zeros(permutations, np.int64), 0
        for batch in batches:
            for ids, has, pairs, part in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids = pc.take(ids.values, pc.sort_indices(ids.values))
                has, pairs = has.values, pairs.values
                names = pc.dictionary_encode(has.field("label"))
                word = names.indices.to_numpy()
                bits = np.zeros((max(1, -(-len(names.dictionary) // 64)), len(ids)), np.uint64)
                np.bitwise_or.at(bits, (word // 64, pc.index_in(has.field("id"), ids).to_numpy()), np.uint64(1) << (word % 64).astype(np.uint64))
                ends = [pc.index_in(pairs.field(x), ids) for x in "ab"]
                both = pc.and_(ends[0].is_valid(), ends[1].is_valid())
                a, b = (x.filter(both).to_numpy() for x in ends)
                if not len(a):
                    continue
                begin, end = part.as_py() * share, min(permutations, (part.as_py() + 1) * share)
                if not begin:
                    observed += int((bits[:, a] & bits[:, b]).any(0).sum())
                step = max(1, (1 << 20) // (len(ids) + len(a)) // _OF_DIGEST * _OF_DIGEST)
                for i in range(begin, end, step):
                    n = min(step, end - i)
                    order = drawn(ids.to_pylist(), i, n, seed)
                    shared = np.zeros((n, len(a)), bool)
                    for w in bits:
                        dealt = w[order]
                        shared |= (dealt[:, a] & dealt[:, b]) != 0
                    hits[i : i + n] += shared.sum(1)
        yield pa.record_batch({"observed": pa.array([observed], pa.int64()), "hits": pa.array([hits.tolist()], pa.list_(pa.int64()))})

    told = rows.mapInArrow(deal, "observed long, hits array<long>")
    each = told.select("observed", F.posexplode("hits").alias("perm", "hits")).groupBy("perm").agg(F.sum("observed").alias("observed"), F.sum("hits").alias("hits"))
    df = each.agg(F.coalesce(F.max("observed"), F.lit(0)).alias("observed"), F.when(F.count("*") > 0, F.count_if(F.col("hits") >= F.col("observed"))).otherwise(permutations).alias("at_least"))
    return df.withColumn("p", (F.col("at_least") + 1) / (permutations + 1))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean columns, as an aggregate; where chance alone agrees, 1 for full agreement and else 0."""
    po = F.avg((a == b).cast("double"))
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def pilot_kappas(first: DataFrame, second: DataFrame, later: DataFrame, least: float = 0.6) -> DataFrame:
    """key, kappa, ok of two labellers' (key, id, applies), over the ids both have; later (key, kappa, priority) overrides."""
    got = first.join(second.select("key", "id", F.col("applies").alias("other")), ["key", "id"]).groupBy("key").agg(kappa(F.col("applies"), F.col("other")).alias("kappa")).withColumn("priority", F.lit(0))
    best = got.unionByName(later.select("key", "kappa", "priority")).groupBy("key").agg(F.max_by("kappa", "priority").alias("kappa"))
    return best.withColumn("ok", F.col("kappa") >= least)


def oversize(labels: DataFrame, retained: DataFrame, tau: int = 30) -> DataFrame:
    """label, n, documented: labels with more than tau rules, and whether a reason to keep them is on record."""
    df = labels.groupBy("label").agg(F.countDistinct("id").alias("n")).where(F.col("n") > tau)
    return df.join(retained.select("label", F.lit(True).alias("d")).distinct(), "label", "left").select("label", "n", F.coalesce("d", F.lit(False)).alias("documented"))


def refinement_problems(registry: DataFrame, labels: DataFrame) -> DataFrame:
    """check, subject: a parent's rule that no child has, a child's that the parent lacks, ordered siblings of which one has no rule alone."""
    tree = registry.where("parent is not null").select("key", "parent")
    child = labels.join(tree, F.col("label") == F.col("key")).select("parent", "key", "id")
    mother = labels.join(tree.select("parent").distinct(), F.col("label") == F.col("parent")).select("parent", "id")
    lost = mother.join(child.select("parent", "id"), ["parent", "id"], "left_anti").select(F.lit("lost").alias("check"), F.concat_ws(":", "parent", "id").alias("subject"))
    gained = child.join(mother, ["parent", "id"], "left_anti").select(F.lit("gained").alias("check"), F.concat_ws(":", "key", "id").alias("subject")).distinct()
    siblings = tree.alias("x").join(tree.alias("y"), "parent").where("x.key <> y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    alone = siblings.join(child.select(F.col("key").alias("a"), "id"), "a").join(child.select(F.col("key").alias("b"), "id"), ["b", "id"], "left_anti").select("a", "b").distinct()
    same = siblings.join(alone, ["a", "b"], "left_anti").select(F.lit("not separated").alias("check"), F.concat_ws(":", "a", "b").alias("subject"))
    return lost.unionByName(gained).unionByName(same)


def gates(registry: DataFrame, labels: DataFrame, rules: DataFrame, chapters: DataFrame, groups: DataFrame, chance: DataFrame | None = None, kappas: DataFrame | None = None, retained: DataFrame | None = None, band: tuple[int, int] = (12, 20), tau: int = 30, least_members: int = 2, most_p: float = 0.01, least_kappa: float = 0.6) -> dict[str, DataFrame | None]:
    """The violations of each of the eight conditions on a taxonomy, by name; None where there is nothing to judge by.

    Shape of the registry, seeds in several chapters and labels that are no section group, labels told apart by their rules, every
    rule labelled and no label too thin, links that share labels more often than chance, pilot agreement, size, and refinement. chance: the row of
    permutation_p or permutation_p_within."""
    last = leaves(registry).select(F.col("key").alias("label"))
    own = labels.join(last, "label", "left_semi")
    thin = last.join(own.groupBy("label").agg(F.countDistinct("id").alias("n")), "label", "left").where(F.coalesce("n", F.lit(0)) < least_members)
    kept = retained if retained is not None else registry.select(F.col("key").alias("label")).limit(0)
    flat = registry.where("parent is not null").isEmpty()
    return {
        "R1": registry_problems(registry, *band).select("subject"),
        "R2": span(registry, chapters).where("not ok").select(F.col("key").alias("subject")).unionByName(coextensive(labels, groups).select(F.col("label").alias("subject"))),
        "R3": nesting(own).where("kind = 'duplicate'").select(F.concat_ws("=", "a", "b").alias("subject")),
        "R4": residue(rules, labels).select(F.col("id").cast("string").alias("subject")).unionByName(thin.select(F.col("label").alias("subject"))),
        "R5": None if chance is None else chance.where(F.col("p") > most_p),
        "R6": None if kappas is None or kappas.isEmpty() else kappas.where(F.col("kappa") < least_kappa),
        "R7": oversize(own, kept, tau).where("not documented"),
        "R8": None if flat else refinement_problems(registry, labels),
    }


def axis_status(votes: DataFrame, coders: int) -> DataFrame:
    """axis, n, status of (axis, coder): unanimous, majority or singleton."""
    df = votes.groupBy("axis").agg(F.countDistinct("coder").alias("n"))
    return df.withColumn("status", F.when(F.col("n") == coders, "unanimous").when(F.col("n") * 2 > coders, "majority").when(F.col("n") == 1, "singleton").otherwise("minority"))


def disagreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: pairs, differ, rate of two labellers' (id, label); what either gave is one pair."""
    df = first.select("id", "label", F.lit(1).alias("x")).join(second.select("id", "label", F.lit(1).alias("y")), ["id", "label"], "full")
    return df.agg(F.count("*").alias("pairs"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("differ")).withColumn("rate", F.try_divide("differ", "pairs"))


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("id", "label").unionByName(second.select("id", "label")).distinct()


def stratified_sample(rules: DataFrame, size: int = 40, seed: int = 0) -> DataFrame:
    """id, chapter: `size` rules (all, if fewer) in turn from the chapters, in each by a seeded hash.

    No chapter gives more than `size`, so every task passes on the least of its own alone and no chapter is gathered or sorted whole (up
    to spark.sql.optimizer.windowGroupLimitThreshold)."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("chapter").orderBy(drawn, "id"))
    return rules.withColumn("k", k).where(F.col("k") <= size).orderBy("k", "chapter").limit(size).select("id", "chapter")


def saturated(proposed: DataFrame, registry: DataFrame) -> DataFrame:
    """axis: proposals that align with no entry of the registry."""
    return proposed.select("axis").distinct().join(registry.select(F.col("key").alias("axis")), "axis", "left_anti")
