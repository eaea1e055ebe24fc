"""URL filter by a path-template tree, in DataFrame functions only.

1. Urls are cut into host and path. Rules (host, path) decide the pages they fit; these
   decisions are the labels from which the tree learns.
2. Paths become shapes: runs of digits and long hexadecimal ids are `#`. Equal shapes of a
   host are one row with counts, so the tree is built over distinct shapes.
3. Per host the tree grows from the root, one segment a level. A segment in fewer than
   `LEAST_PAGES` pages under its parent becomes the wildcard `*`.
4. Sibling branches with the same signature (lengths of what follows, and whether numbers
   follow) are parted by their share of blocked pages: like that of all of them together,
   above or below it (two-sided test at 5 %). Those of a part whose share does not differ
   from that of the part are merged into one branch, named after its least member.
5. A node's purity is its share of blocked among labelled pages, smoothed towards its
   parent's with the weight of `PRIOR` pages, the root's towards the share over all hosts.
   Pages that no rule fits are rejected where the purity of their template is `REJECT`.

A shape deeper than `DEPTH` segments ends in `**` and takes the purity of its first ones.
Counts are combined before each shuffle; the join of pages to verdicts splits hot shapes.
Null urls and urls without `://` have an empty host and path and are judged like any other;
repeated rows and null ids are rows of their own; an empty table gives none. Only page_id
and url are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.skew import hot_key_join, hot_keys, salted_join
from reviewmill.session import staged

# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEPTH = 4
LEAST_PAGES = 10
PRIOR = 4.0
REJECT = 0.6
CHI_SQUARE = 3.84
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NODE = ["host", "prefix", "kind"]


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every row."""
    rest = F.substring(F.col("url"), F.locate("://", "url") + 3, F.length("url"))
    found = F.coalesce(F.locate("://", "url") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)
    return pages.select(
        "page_id", F.when(found, host).otherwise("").alias("host"), F.when(found, path).otherwise("").alias("path"))


def _decided(rules, value) -> Column:
    """`value` of the longest rule that fits the host or a parent domain and starts the path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def ruled(parts: DataFrame, rules=RULES) -> DataFrame:
    """`parts` with the rule that decides, as host and path in one, and its verdict; null without one."""
    return parts.withColumns({
        "rule": _decided(rules, lambda r: r[1] + r[2]), "decided": _decided(rules, lambda r: r[0])})


def _shape(path: str = "path") -> Column:
    plain = F.regexp_replace(path, "[0-9a-fA-F]{16,}", "#")
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "#"), "^/|/\\z", "")


def _smoothed(blocked: Column, labelled: Column, towards: Column, prior: float) -> Column:
    return (blocked + F.lit(prior) * towards) / (labelled + F.lit(prior))


def _compared(nodes: DataFrame, group: list[str]) -> DataFrame:
    """`apart`, a node's blocked pages beyond its share in its group, and `similar`, whether chance explains it."""
    pooled = nodes.groupBy(*group).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    share = (F.col("all_blocked") + 1.0) / (F.col("all_labelled") + 2.0)
    apart = F.col("blocked") - F.col("labelled") * share
    similar = apart * apart <= CHI_SQUARE * (F.col("labelled") * share * (1.0 - share))
    return salted_join(nodes, pooled, group, ["kind"]).select(
        *nodes.columns, apart.alias("apart"), similar.alias("similar"))


def _level(shapes: DataFrame, depth: int, least: int, prior: float) -> DataFrame:
    """`shapes` with prefix and rate one segment further."""
    segments = F.col("segments")
    live = F.size(segments) > depth
    after = F.size(segments) - depth - 1
    numbered = F.coalesce(F.get(segments, F.lit(depth + 1)).contains("#"), F.lit(False))
    rows = shapes.withColumn("segment", F.when(live, F.get(segments, F.lit(depth))))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "numbered")]
    ends = [F.min("least").alias("least"), F.max("most").alias("most")]
    children = staged(
        rows.where(live).withColumns({
            "least": after, "most": after, "numbered": F.when(numbered, F.col("n")).otherwise(F.lit(0).cast("long"))})
        .groupBy("host", "prefix", "segment").agg(*sums, *ends))
    literal = F.col("n") >= least
    nodes = (
        children.withColumn("kind", F.when(literal, F.col("segment")).otherwise("*"))
        .groupBy(*_NODE).agg(*sums, *ends)
        .withColumn("signature", F.concat_ws(
            "-", "least", "most", F.when(2 * F.col("numbered") > F.col("n"), "#").otherwise("w")))
    )
    parted = _compared(nodes, ["host", "prefix", "signature"]).withColumn(
        "side", F.when(F.col("similar"), "~").when(F.col("apart") > 0, "+").otherwise("-")).drop("similar", "apart")
    tested = _compared(parted, ["host", "prefix", "signature", "side"]).withColumn(
        "group", F.when(F.col("similar"), F.concat("side", "signature")).otherwise(F.concat(F.lit("="), "kind")))
    merged = tested.groupBy("host", "prefix", "group").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
        F.min("kind").alias("first"), F.count("*").alias("members"))
    name = F.when(F.col("members") == 1, F.col("first")).otherwise(
        F.concat(F.lit("{"), "first", F.lit("+"), (F.col("members") - 1).cast("string"), F.lit("}")))
    branches = staged(
        salted_join(tested.select(*_NODE, "group"), merged.withColumn("branch", name), ["host", "prefix", "group"], ["kind"])
        .select(*_NODE, "branch", "all_labelled", "all_blocked"))
    known = children.where(literal).select("host", "prefix", "segment", F.lit(True).alias("literal"))
    kinds = salted_join(rows, known, ["host", "prefix", "segment"], ["shape"], "left").withColumn(
        "kind", F.when(live, F.when(F.col("literal"), F.col("segment")).otherwise("*")))
    placed = salted_join(kinds, branches, _NODE, ["shape"], "left")
    rate = _smoothed(F.col("all_blocked"), F.col("all_labelled"), F.col("rate"), prior)
    return staged(placed.select(
        "host", "shape", "n", "labelled", "blocked", "segments",
        F.when(live, F.concat("prefix", F.lit("/"), "branch")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(live, rate).otherwise(F.col("rate")).alias("rate")))


def templates(labelled: DataFrame, depth: int = DEPTH, least: int = LEAST_PAGES, prior: float = PRIOR) -> DataFrame:
    """host, shape, n, template and purity of each distinct shape of (host, shape, label).

    `label` is 1 for a blocked page, 0 for an allowed one and null where it is unknown.
    """
    shapes = staged(labelled.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked")))
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    total = shapes.agg(F.sum("labelled"), F.sum("blocked"), F.max(F.size(segments))).first()
    base = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    hosts = shapes.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(base), prior).alias("rate"))
    tree = salted_join(shapes, hosts, ["host"], ["shape"]).withColumn("segments", segments).withColumn("prefix", F.lit(""))
    for level in range(min(depth, total[2] or 0)):
        tree = _level(tree, level, least, prior)
    deeper = F.when(F.size("segments") > depth, "/**").otherwise("")
    return tree.select("host", "shape", "n", F.concat("host", "prefix", deeper).alias("template"), F.col("rate").alias("purity"))


def judged(pages: DataFrame, rules=RULES, reject: float = REJECT, depth: int = DEPTH, least: int = LEAST_PAGES,
           prior: float = PRIOR) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of (page_id, url)."""
    label = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    rows = staged(ruled(url_parts(pages), rules).withColumns({"shape": _shape(), "label": label}))
    tree = staged(templates(rows.select("host", "shape", "label"), depth, least, prior))
    hot = hot_keys(tree, ["host", "shape"], "n")
    joined = hot_key_join(rows, tree.drop("n"), ["host", "shape"], hot, ["page_id", "path"])
    learnt = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", learnt).alias("verdict"), "template", "purity")


def _sql_case(value) -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        _, host, path = rule
        out = (f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') "
               f"THEN '{value(rule)}' ELSE {out} END")
    return out


_SQL_SIMILAR = f"""(blocked - labelled * share) * (blocked - labelled * share)
                    <= {CHI_SQUARE}::DOUBLE * (labelled * share * (1::DOUBLE - share))"""


def _sql_level(d: int) -> str:
    """The tables of one level: `tree{d + 1}` from `tree{d}`."""
    return f"""
rows{d} AS (SELECT *, len(segments) > {d} AS live, segments[{d + 1}] AS segment FROM tree{d}),
children{d} AS (
    SELECT host, prefix, segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked,
           sum(CASE WHEN contains(segments[{d + 2}], '#') THEN n ELSE 0 END) AS numbered,
           min(len(segments) - {d + 1}) AS least, max(len(segments) - {d + 1}) AS most
    FROM rows{d} WHERE live GROUP BY ALL),
nodes{d} AS (
    SELECT host, prefix, CASE WHEN n >= {LEAST_PAGES} THEN segment ELSE '*' END AS kind, sum(labelled) AS labelled,
           sum(blocked) AS blocked, concat(min(least), '-', max(most), '-',
               CASE WHEN 2 * sum(numbered) > sum(n) THEN '#' ELSE 'w' END) AS signature
    FROM children{d} GROUP BY ALL),
pooled{d} AS (
    SELECT *, (sum(blocked) OVER w + 1::DOUBLE) / (sum(labelled) OVER w + 2::DOUBLE) AS share
    FROM nodes{d} WINDOW w AS (PARTITION BY host, prefix, signature)),
parted{d} AS (
    SELECT host, prefix, kind, labelled, blocked, signature, CASE
               WHEN {_SQL_SIMILAR} THEN '~' WHEN blocked - labelled * share > 0 THEN '+' ELSE '-' END AS side
    FROM pooled{d}),
again{d} AS (
    SELECT *, (sum(blocked) OVER w + 1::DOUBLE) / (sum(labelled) OVER w + 2::DOUBLE) AS share
    FROM parted{d} WINDOW w AS (PARTITION BY host, prefix, signature, side)),
tested{d} AS (
    SELECT *, CASE WHEN {_SQL_SIMILAR} THEN side || signature ELSE '=' || kind END AS bundle
    FROM again{d}),
branches{d} AS (
    SELECT host, prefix, kind, sum(labelled) OVER w AS all_labelled, sum(blocked) OVER w AS all_blocked,
           CASE WHEN count(*) OVER w = 1 THEN kind
                ELSE concat('{{', min(kind) OVER w, '+', count(*) OVER w - 1, '}}') END AS branch
    FROM tested{d} WINDOW w AS (PARTITION BY host, prefix, bundle)),
kinds{d} AS (
    SELECT r.*, CASE WHEN c.n >= {LEAST_PAGES} THEN r.segment ELSE '*' END AS kind
    FROM rows{d} r LEFT JOIN children{d} c ON r.live AND r.host = c.host AND r.prefix = c.prefix AND r.segment = c.segment),
tree{d + 1} AS (
    SELECT k.host, k.shape, k.n, k.labelled, k.blocked, k.segments,
           CASE WHEN live THEN concat(k.prefix, '/', branch) ELSE k.prefix END AS prefix,
           CASE WHEN live THEN (all_blocked + {PRIOR}::DOUBLE * rate) / (all_labelled + {PRIOR}::DOUBLE) ELSE rate END AS rate
    FROM kinds{d} k LEFT JOIN branches{d} b ON live AND k.host = b.host AND k.prefix = b.prefix AND k.kind = b.kind),"""


ORACLE = f"""
WITH rested AS (
    SELECT page_id, coalesce(strpos(url, '://'), 0) > 0 AS found, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
    SELECT page_id,
           CASE WHEN found THEN translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') ELSE '' END AS host,
           CASE WHEN found THEN regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) ELSE '' END AS path
    FROM rested),
ruled AS (
    SELECT *, {_sql_case(lambda r: r[1] + r[2])} AS rule, {_sql_case(lambda r: r[0])} AS decided,
           regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g'),
                          '^/|/\\z', '', 'g') AS shape
    FROM parts),
shapes AS (
    SELECT host, shape, count(*) AS n, count(decided) AS labelled, count(*) FILTER (decided = 'block') AS blocked
    FROM ruled GROUP BY host, shape),
base AS (SELECT (sum(blocked) + 1::DOUBLE) / (sum(labelled) + 2::DOUBLE) AS share FROM shapes),
tree0 AS (
    SELECT host, shape, n, labelled, blocked, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS segments,
           '' AS prefix, (sum(blocked) OVER (PARTITION BY host) + {PRIOR}::DOUBLE * share)
           / (sum(labelled) OVER (PARTITION BY host) + {PRIOR}::DOUBLE) AS rate
    FROM shapes, base),{"".join(map(_sql_level, range(DEPTH)))}
tree AS (
    SELECT host, shape, concat(host, prefix, CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END) AS template, rate AS purity
    FROM tree{DEPTH})
SELECT page_id, host, path, rule,
       coalesce(decided, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled JOIN tree USING (host, shape)"""
