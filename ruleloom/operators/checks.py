"""Integrity checks as tables of violations (check, subject, detail); an empty table means that all hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.functions import text as T
from ruleloom.sources.lines import paired_lines

from . import edges as E
from . import rules as R


def violations(df: DataFrame, check: str, subject, detail=None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject") if isinstance(subject, str) else subject.cast("string").alias("subject"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def anonymization(raw: DataFrame, anonymized: DataFrame, brands: list[str]) -> DataFrame:
    """Lines that only one text has, and lines that changed although the first names no brand."""
    both = paired_lines(raw, anonymized)
    named = reduce(lambda a, b: a | b, (F.contains(F.lower("raw"), F.lit(b.lower())) for b in brands), F.lit(False))
    return all_of(
        violations(both.where("raw is null or other is null"), "line count", F.concat_ws(":", "spec", "ln")),
        violations(both.where(F.col("raw") != F.col("other")).where(~named), "changed without a brand", F.concat_ws(":", "spec", "ln")),
    )


def annotation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Texts (spec, text): words other than added tags, repeated rule ids and example tags, examples without a tag."""
    first = R.additions_only(before, after)
    ids = after.select("spec", F.explode(T.rule_ids(F.col("text"))).alias("rule"))
    tags = after.select("spec", F.explode(F.regexp_extract_all("text", F.lit(T.EXAMPLE_MARKER), F.lit(1))).alias("rule"))
    count = lambda df, pattern, name: df.select("spec", F.regexp_count("text", F.lit(pattern)).alias(name))
    cover = count(before, r"\*\*Example\*\*", "expected").join(count(after, r"\*\*Example\[\^eg\d{3}\]\*\*", "tagged"), "spec")
    return all_of(
        violations(first.where("not ok"), "words", "spec", F.concat_ws(" ", "place", "word")),
        violations(R.repeats(ids, "spec", "rule"), "repeated rule", "spec", F.col("rule")),
        violations(R.repeats(tags, "spec", "rule"), "repeated example", "spec", F.col("rule")),
        violations(cover.where("expected > 0 and tagged <> expected"), "example coverage", "spec", F.concat_ws("/", "tagged", "expected")),
    )


def rule_records(rules: DataFrame, markers: DataFrame, examples: DataFrame, structure: DataFrame) -> DataFrame:
    """Records against the text: ids, repeated ids, vocabularies, blank fields, unknown examples, sections and authority.

    rules: the fields of schema.RULE with `rule` for id; structure: rule, sections, authority as derived from the text."""
    ids = R.missing_and_extra(markers, rules, "rule")
    known = rules.join(structure.select("rule", F.col("sections").alias("s"), F.col("authority").alias("a")), "rule")
    used = rules.select("rule", F.explode("examples").alias("example")).join(examples.select("example"), "example", "left_anti")
    return all_of(
        violations(ids, "identifiers", "rule", F.col("side")),
        violations(R.repeats(rules, "rule"), "repeated", "rule"),
        violations(rules.where(~F.coalesce(F.col("modality").isin(*schema.MODALITIES), F.lit(False))), "modality", "rule"),
        violations(rules.where(F.col("authority").isNotNull() & ~F.col("authority").isin(*schema.AUTHORITIES)), "authority term", "rule"),
        violations(rules.where(reduce(lambda a, b: a | b, ((F.coalesce(T.strip(F.col(c)), F.lit("")) == "") for c in ("text", "trigger", "behavior")))), "blank field", "rule"),
        violations(used, "unknown example", "rule", F.col("example")),
        violations(known.where("sections <> s"), "sections", "rule"),
        violations(known.where("a is not null and not authority <=> a"), "authority", "rule"),
    )


#: Hashes of ids are below this prime.
_PRIME = (1 << 31) - 1


def _hash(c: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(_PRIME)).cast("decimal(10,0)")


def _expected(members: DataFrame, by: list[str]) -> DataFrame:
    """by, n, f, g, d: a group's number and sums of two hashes of its ids and of their product: all that a fingerprint of its pairs takes."""
    f, g = _hash(F.col("id"), 7), _hash(F.col("id"), 8)
    return members.groupBy(*by).agg(F.count("*").alias("n"), F.sum(f).alias("f"), F.sum(g).alias("g"), F.sum(f * g).alias("d"))


def _given(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, pairs, print: number of edges and sum of the products of their ends' hashes; any order gives the same."""
    return edges.groupBy(*by).agg(F.count("*").alias("pairs"), F.sum(_hash(F.col("src"), 7) * _hash(F.col("dst"), 8)).alias("print"))


def _unlike(want: DataFrame, have: DataFrame, by: list[str]) -> DataFrame:
    """The groups whose number or fingerprint of pairs differs."""
    zero = lambda c: F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    met = want.join(have.withColumnsRenamed({"pairs": "__p", "print": "__q"}), by, "full")
    return met.where((zero("pairs") != zero("__p")) | (zero("print") != zero("__q"))).select(*by)


def _differences(want: DataFrame, have: DataFrame) -> DataFrame:
    return want.exceptAll(have).withColumn("s", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("s", F.lit("extra")))


def section_pair_problems(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, s: ordered pairs of rules (rule, path) of one path that the edges (src, dst) lack or have too much.

    The pairs of a section are a sum over all less one over equal ends, so its fingerprint needs one look at its rules; only sections
    whose edges have another one are listed as pairs."""
    at = rules.select(F.col("rule").alias("id"), "path").distinct()
    end = lambda x: at.select(F.col("id").alias(x), F.col("path").alias(f"__{x}"))
    placed = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    same = F.coalesce(F.col("__src") == F.col("__dst"), F.lit(False))
    inside, astray = placed.where(same).select("src", "dst", F.col("__src").alias("path")), placed.where(~same)
    want = _expected(at, ["path"]).select("path", (F.col("n") * (F.col("n") - 1)).alias("pairs"), (F.col("f") * F.col("g") - F.col("d")).alias("print"))
    unlike = _unlike(want, _given(inside, ["path"]), ["path"])
    listed = E.pairs(at.join(unlike, "path", "left_semi"), "id", ["path"]).select("src", "dst")
    return _differences(listed, inside.join(unlike, "path", "left_semi").select("src", "dst")).unionByName(astray.select("src", "dst", F.lit("extra").alias("s")))


def shared_label_problems(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, s: ordered pairs of ids that share labels, which the edges (src, dst, via) lack, have too much or with other labels.

    Rules with one set of labels are a class. Classes meet by label, and what two share is the same for all their pairs; so
    fingerprints are compared by two classes, and only where they differ are pairs listed."""
    held = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("set"))
    sets = _expected(held, ["set"])
    each = sets.select("set", F.explode("set").alias("label"))
    met = each.join(each.withColumnRenamed("set", "other"), "label").select("set", "other").distinct()
    mine, theirs = sets.select("set", "n", "f", "d"), sets.select(F.col("set").alias("other"), F.col("n").alias("m"), "g")
    own = F.col("set") == F.col("other")
    want = met.join(mine, "set").join(theirs, "other").select("set", "other", (F.col("n") * F.col("m") - F.when(own, F.col("n")).otherwise(0)).alias("pairs"), (F.col("f") * F.col("g") - F.when(own, F.col("d")).otherwise(0)).alias("print"))
    end = lambda x, name: held.select(F.col("id").alias(x), F.col("set").alias(name))
    placed = edges.join(end("src", "set"), "src", "left").join(end("dst", "other"), "dst", "left")
    right = F.coalesce((F.array_sort(F.array_intersect("set", "other")) == F.col("via")) & (F.size("via") > 0), F.lit(False))
    fine, astray = placed.where(right).select("src", "dst", "set", "other"), placed.where(~right)
    key = ["set", "other"]
    unlike = _unlike(want, _given(fine, key), key)
    listed = unlike.join(held.select("set", F.col("id").alias("src")), "set").join(held.select(F.col("set").alias("other"), F.col("id").alias("dst")), "other").where("src <> dst")
    return _differences(listed.select("src", "dst"), fine.join(unlike, key, "left_semi").select("src", "dst")).unionByName(astray.select("src", "dst", F.lit("extra").alias("s")))


def grouped(rules: DataFrame, edges: DataFrame, labels: DataFrame, registry: DataFrame, groups: DataFrame, inventory: DataFrame) -> DataFrame:
    """The graph against what it was made of: closed identifiers, mirrors, terms, labels, pairs, groups and their members.

    rules: rule, sections; edges: src, dst, relation, subtype, direction, via; labels: id, label; registry: key; groups: gid, members."""
    ends = edges.select(F.col("src").alias("rule")).unionByName(edges.select(F.col("dst").alias("rule"))).distinct()
    have = edges.where("relation = 'shares_dimension'").select("src", "dst", "via")
    drawn = edges.where("relation = 'same_section'").select("src", "dst")
    wanted = E.label_groups(labels).select("gid", "members").unionByName(E.section_groups(rules.withColumn("authority", F.lit(None).cast("string"))).select("gid", "members"))
    is_ = groups.select("gid", F.array_sort("members").alias("members"))
    pair = F.concat_ws(">", "src", "dst")
    return all_of(
        violations(R.missing_and_extra(inventory, rules, "rule"), "identifiers", "rule", F.col("side")),
        violations(ends.join(rules, "rule", "left_anti"), "unknown end", "rule"),
        violations(edges.where("src = dst"), "loop", "src"),
        violations(E.asymmetric(edges, ["relation", "subtype", "via"]), "no mirror", pair, F.col("relation")),
        violations(E.bad_terms(edges), "term", pair, F.col("problem")),
        violations(labels.join(registry.select(F.col("key").alias("label")), "label", "left_anti"), "unknown label", "id", F.col("label")),
        violations(rules.select(F.col("rule").alias("id")).join(labels, "id", "left_anti"), "no label", "id"),
        violations(shared_label_problems(labels, have), "shares_dimension", pair, F.col("s")),
        violations(section_pair_problems(rules.select("rule", F.array_join("sections", "/").alias("path")), drawn), "same_section", pair, F.col("s")),
        violations(wanted.exceptAll(is_).withColumn("s", F.lit("missing")).unionByName(is_.exceptAll(wanted).withColumn("s", F.lit("extra"))), "groups", "gid", F.col("s")),
    )


def grouped_again(rules: DataFrame, edges: DataFrame, labels: DataFrame, registry: DataFrame, groups: DataFrame, inventory: DataFrame) -> DataFrame:
    """check, subject, detail: what grouped() looks at, said once more in SQL and by sets, without the operators that have built
    the graph or its fingerprints; a fault in one of those shows here. The inputs are grouped()'s. Pairs are listed only for sections and
    classes of labels whose number or mark of pairs differs."""
    spark = rules.sparkSession
    return spark.sql(
        """
        WITH held AS (SELECT id, array_join(array_sort(collect_set(label)), '\u0001') AS set, conv(left(md5(concat('a', id)), 7), 16, 10) AS x, conv(left(md5(concat('b', id)), 7), 16, 10) AS y FROM {labels} GROUP BY id),
        class AS (SELECT set, count(*) AS n, sum(CAST(x AS DECIMAL(10))) AS x, sum(CAST(y AS DECIMAL(10))) AS y, sum(CAST(x AS DECIMAL(10)) * CAST(y AS DECIMAL(10))) AS xy FROM held GROUP BY set),
        word AS (SELECT set, explode(split(set, '\u0001')) AS label FROM class),
        touch AS (SELECT DISTINCT a.set AS one, b.set AS two FROM word a JOIN word b ON a.label = b.label),
        due AS (SELECT t.one, t.two, a.n * b.n - IF(t.one = t.two, a.n, 0) AS n, a.x * b.y - IF(t.one = t.two, a.xy, 0) AS mark FROM touch t JOIN class a ON a.set = t.one JOIN class b ON b.set = t.two),
        drawn AS (SELECT e.src, e.dst, e.via, a.set AS one, b.set AS two, a.x AS x, b.y AS y FROM {edges} e LEFT JOIN held a ON a.id = e.src LEFT JOIN held b ON b.id = e.dst WHERE e.relation = 'shares_dimension'),
        good AS (SELECT * FROM drawn WHERE size(via) > 0 AND via = array_sort(array_intersect(split(one, '\u0001'), split(two, '\u0001')))),
        paid AS (SELECT one, two, count(*) AS n, sum(CAST(x AS DECIMAL(10)) * CAST(y AS DECIMAL(10))) AS mark FROM good GROUP BY one, two),
        odd AS (SELECT coalesce(d.one, p.one) AS one, coalesce(d.two, p.two) AS two FROM due d FULL JOIN paid p ON d.one = p.one AND d.two = p.two WHERE NOT (coalesce(d.n, 0) = coalesce(p.n, 0) AND coalesce(d.mark, 0) = coalesce(p.mark, 0))),
        share AS (SELECT a.id AS src, b.id AS dst FROM odd o JOIN held a ON a.set = o.one JOIN held b ON b.set = o.two WHERE a.id <> b.id),
        placed AS (SELECT DISTINCT rule, array_join(sections, '/') AS path, conv(left(md5(concat('a', rule)), 7), 16, 10) AS x, conv(left(md5(concat('b', rule)), 7), 16, 10) AS y FROM {rules}),
        room AS (SELECT path, count(*) * (count(*) - 1) AS n, sum(CAST(x AS DECIMAL(10))) * sum(CAST(y AS DECIMAL(10))) - sum(CAST(x AS DECIMAL(10)) * CAST(y AS DECIMAL(10))) AS mark FROM placed GROUP BY path),
        beside AS (SELECT e.src, e.dst, a.path AS one, b.path AS two, a.x AS x, b.y AS y FROM {edges} e LEFT JOIN placed a ON a.rule = e.src LEFT JOIN placed b ON b.rule = e.dst WHERE e.relation = 'same_section'),
        filled AS (SELECT one, count(*) AS n, sum(CAST(x AS DECIMAL(10)) * CAST(y AS DECIMAL(10))) AS mark FROM beside WHERE one = two GROUP BY one),
        uneven AS (SELECT coalesce(r.path, f.one) AS path FROM room r FULL JOIN filled f ON r.path = f.one WHERE NOT (coalesce(r.n, 0) = coalesce(f.n, 0) AND coalesce(r.mark, 0) = coalesce(f.mark, 0))),
        near AS (SELECT a.rule AS src, b.rule AS dst FROM uneven u JOIN placed a ON a.path = u.path JOIN placed b ON b.path = u.path WHERE a.rule <> b.rule),
        want AS (SELECT concat('dim:', label) AS gid, array_sort(collect_set(id)) AS members FROM {labels} GROUP BY label UNION ALL SELECT concat('sec:', path), array_sort(collect_set(rule)) FROM placed GROUP BY path),
        have AS (SELECT gid, array_sort(members) AS members FROM {groups}),
        seen AS (SELECT src, dst, relation, subtype, direction, array_join(via, ',') AS via FROM {edges})
        SELECT 'identifiers' AS check, CAST(rule AS STRING) AS subject, 'missing' AS detail FROM {inventory} i LEFT ANTI JOIN {rules} r ON r.rule = i.rule
        UNION ALL SELECT 'identifiers', CAST(rule AS STRING), 'extra' FROM {rules} r LEFT ANTI JOIN {inventory} i ON r.rule = i.rule
        UNION ALL SELECT 'unknown end', CAST(rule AS STRING), NULL FROM (SELECT src AS rule FROM {edges} UNION SELECT dst FROM {edges}) e LEFT ANTI JOIN {rules} r ON r.rule = e.rule
        UNION ALL SELECT 'loop', CAST(src AS STRING), NULL FROM {edges} WHERE src = dst
        UNION ALL SELECT 'no mirror', concat_ws('>', src, dst), relation FROM seen e WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.src = e.dst AND b.dst = e.src AND b.relation <=> e.relation AND b.subtype <=> e.subtype AND b.via <=> e.via
          AND b.direction = CASE e.direction WHEN 'out' THEN 'in' WHEN 'in' THEN 'out' ELSE 'none' END)
        UNION ALL SELECT 'unknown label', CAST(id AS STRING), label FROM {labels} l LEFT ANTI JOIN {registry} g ON g.key = l.label
        UNION ALL SELECT 'no label', CAST(r.rule AS STRING), NULL FROM {rules} r LEFT ANTI JOIN held h ON h.id = r.rule
        UNION ALL SELECT 'shares_dimension', concat_ws('>', src, dst), 'missing' FROM (SELECT src, dst FROM share EXCEPT ALL SELECT src, dst FROM good)
        UNION ALL SELECT 'shares_dimension', concat_ws('>', src, dst), 'extra' FROM (SELECT g.src, g.dst FROM good g LEFT SEMI JOIN odd o ON o.one = g.one AND o.two = g.two EXCEPT ALL SELECT src, dst FROM share)
        UNION ALL SELECT 'shares_dimension', concat_ws('>', src, dst), 'extra' FROM (SELECT src, dst FROM drawn EXCEPT ALL SELECT src, dst FROM good)
        UNION ALL SELECT 'same_section', concat_ws('>', src, dst), 'missing' FROM (SELECT src, dst FROM near EXCEPT ALL SELECT src, dst FROM beside)
        UNION ALL SELECT 'same_section', concat_ws('>', src, dst), 'extra' FROM (SELECT b.src, b.dst FROM beside b LEFT SEMI JOIN uneven u ON u.path = b.one WHERE b.one = b.two EXCEPT ALL SELECT src, dst FROM near)
        UNION ALL SELECT 'same_section', concat_ws('>', src, dst), 'extra' FROM beside WHERE NOT coalesce(one = two, false)
        UNION ALL SELECT 'groups', w.gid, 'missing' FROM want w LEFT ANTI JOIN have h ON h.gid = w.gid AND h.members = w.members
        UNION ALL SELECT 'groups', h.gid, 'extra' FROM have h LEFT ANTI JOIN want w ON h.gid = w.gid AND h.members = w.members
        """,
        rules=rules.select("rule", "sections"), edges=edges.select("src", "dst", "relation", "subtype", "direction", "via"), labels=labels.select("id", "label"), registry=registry.select("key"), groups=groups.select("gid", "members"), inventory=inventory.select("rule"),
    )


def verdicts(table: DataFrame, conditions: list[str]) -> DataFrame:
    """condition, verdict (PASS, FAIL), n for each condition, from its violations."""
    names = table.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
    n = table.groupBy(F.col("check").alias("condition")).agg(F.count("*").alias("n"))
    return names.join(n, "condition", "left").select("condition", F.when(F.col("n").isNull(), "PASS").otherwise("FAIL").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


#: Buckets of the digests' two levels.
BUCKETS, WITHIN = 64, 64


def _row(df: DataFrame) -> Column:
    """A row as text that tells nulls and columns apart."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def _bucket(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(_row(df), F.lit(1)), F.lit(BUCKETS * WITHIN)).cast("int")


def row_digests(df: DataFrame) -> DataFrame:
    """bucket, n, sum, other: of each bucket of rows their number and two sums of hashes, the same in whatever order the rows lie. To be
    written beside a run: at most BUCKETS x WITHIN rows."""
    total = lambda salt: F.sum(F.xxhash64(_row(df), F.lit(salt)).cast("decimal(38,0)"))
    return df.groupBy(_bucket(df).alias("bucket")).agg(F.count("*").alias("n"), total(2).alias("sum"), total(3).alias("other"))


def rerun_difference(first: DataFrame, second: DataFrame, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows that one of two runs has more often, with only_in.

    Digests are compared first, those of the upper level (sums over WITHIN buckets) and then those within what differs; rows are read and
    compared only in buckets that differ. With the digests that the runs have written, equal tables aren't read at all."""
    a, b = digests or (row_digests(first), row_digests(second))
    spark = first.sparkSession
    told = lambda df, side: df.select("bucket", F.floor(F.col("bucket") / WITHIN).cast("int").alias("upper"), F.struct("n", "sum", "other").alias(side))
    both = told(a, "a").join(told(b, "b"), ["bucket", "upper"], "full").select("bucket", "upper", "a", "b").collect()  # bounded: BUCKETS x WITHIN
    upper: dict[int, list] = {}
    for r in both:
        s = upper.setdefault(r["upper"], [0] * 6)
        for k, side in ((0, r["a"]), (3, r["b"])):
            for i, x in enumerate(side or (0, 0, 0)):
                s[k + i] += x
    open_ = {u for u, s in upper.items() if s[:3] != s[3:]}
    differ = [r["bucket"] for r in both if r["upper"] in open_ and r["a"] != r["b"]]
    if not differ:
        return spark.createDataFrame([], first.schema).withColumn("only_in", F.lit("first"))
    within = lambda df: df.where(_bucket(df).isin(differ))
    x, y = within(first), within(second.select(*first.columns))
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))


def hash_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, problem of manifest (name, sha256) against files (name, sha256): missing, changed, unlisted."""
    df = manifest.join(files.select("name", F.col("sha256").alias("now"), F.lit(True).alias("there")), "name", "full")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") != F.col("now"), "changed")
    return df.withColumn("problem", problem).where("problem is not null").select("name", "problem")


def provenance(manifest: DataFrame, files: DataFrame, runs: DataFrame, parents: DataFrame, ledger: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """Where what a run holds isn't what its records say: files against the manifest's hashes, the parent's manifest against the hash
    that the run was made from, the batch of its results against the ledger's, and the ids of results against those asked for.

    manifest, files: name, sha256; runs: run, parent, parent_sha256; parents: parent, sha256; ledger: run, batch; requests: run,
    custom_id; results: run, batch, custom_id."""
    named = F.concat_ws("/", "run", "custom_id")
    lost = runs.join(parents, "parent", "left").where(~F.col("sha256").eqNullSafe(F.col("parent_sha256")))
    other = results.select("run", "batch").distinct().join(ledger.select("run", F.col("batch").alias("filed")), "run", "left").where(~F.col("batch").eqNullSafe(F.col("filed")))
    ids = R.missing_and_extra(requests.select(named.alias("id")), results.select(named.alias("id")), "id")
    return all_of(
        violations(hash_problems(manifest, files), "manifest", "name", F.col("problem")),
        violations(lost, "parent", "run", F.col("parent")),
        violations(other, "batch", "run", F.col("batch")),
        violations(ids, "results", "id", F.col("side")),
    )
