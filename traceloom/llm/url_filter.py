"""URL filters: fixed rules, and a path-template tree per host, with DataFrame operations only.

Rules decide the URLs that they fit, and label them for the tree. The tree of a host has its paths' segments as
nodes. Runs of digits and long hexadecimal segments are wildcards at once, so the tree is built over (host, shape)
counts and not over URLs. From the root down a node's children become one wildcard where they vary: many of them, seen
about once each. Then siblings are merged whose shares of blocked pages don't differ significantly, those without
labelled pages among themselves. A merged template's purity is its share of blocked labelled pages, smoothed
towards its parent's, and so on up to the host and to all hosts. Templates with labelled pages and a purity above
``reject`` are rejected. One without labelled pages has its parent's purity and is rejected only above ``sure``: where
dozens of labelled pages around it are blocked and hardly any is allowed.

A stretch of segments that all of a node's shapes have in common has no siblings: it is passed in one step, however long, and the
purity at its end is that of the repeated smoothing in closed form. So a round passes a stretch and one branching, and there are
as many rounds as branchings on a way through the tree: one deep URL costs no more than a flat one.

All shuffles but the last are of counts, pre-aggregated; the last join brings a verdict per (host, shape) to the URLs,
an equi-join in which adaptive execution splits a hot host, or broadcasts the verdicts if their measured size allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import stored

# Fixed rules: (verdict, host and its subdomains, start of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels of the tree in the SQL, which has no rounds; url_verdicts() has no such limit.
SQL_LEVELS = 4
MANY = 8
SEEN = 3.0
WEIGHT = 4.0
REJECT = 0.5
#: How many standard errors the blocked shares of neighbouring siblings must differ by to stay apart (two-proportion test).
Z = 1.96
SURE = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule comes later and goes first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, joined by /; digits and long hexadecimal segments as *."""
    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    cut = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(s, r"^(?:[0-9a-fA-F-]{16,})$", "*"), r"[0-9]+", "*"))
    return F.array_join(cut, "/")


def common_length(a: Column, b: Column) -> Column:
    """How many items two arrays share from their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, F.lit(False))
    return F.when(differ == 0, F.size(same)).otherwise(differ - 1).cast("int")


def smoothed(blocked: Column, labelled: Column, purity: Column, weight: float) -> Column:
    return (blocked + weight * purity) / (labelled + weight)


def passed(rows: DataFrame, weight: float) -> DataFrame:
    """rows beyond the stretch that all shapes of their node share: shorter rests, and the purity and own at its end.

    Smoothing k times with the same counts leaves the share b / l plus (w / (l + w))^k of the distance to it.
    """
    # of sorted arrays the first and the last share least
    nodes = rows.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    nodes = nodes.withColumn("k", common_length(F.col("lo"), F.col("hi"))).where("k > 0").select(F.col("host").alias("h"), F.col("node").alias("at"), "k", "l", "b")
    both = rows.join(nodes, (F.col("host") == F.col("h")) & (F.col("node") == F.col("at")), "left")
    share = F.col("b") / F.col("l")
    after = F.when(F.col("k") == 1, smoothed(F.col("b"), F.col("l"), F.col("purity"), weight)).when(F.col("l") > 0, share + (F.col("purity") - share) * F.pow(weight / (F.col("l") + weight), F.col("k"))).otherwise(F.col("purity"))
    moved = F.col("k").isNotNull()
    rest = F.when(moved, F.slice("rest", F.col("k") + 1, F.size("rest"))).otherwise(F.col("rest"))
    return both.select("host", "shape", "node", rest.alias("rest"), "n", "labelled", "blocked", F.when(moved, after).otherwise(F.col("purity")).alias("purity"), F.when(moved, F.col("l")).otherwise(F.col("own")).alias("own"))


def branched(rows: DataFrame, weight: float, many: int, seen: float) -> DataFrame:
    """rows (none at its end) one segment further: children generalised, siblings merged, purities smoothed towards the parent's."""
    rows = rows.withColumn("child", F.col("rest")[0])
    kids = rows.groupBy("host", "node", "child").agg(F.sum("n").alias("n"))
    kids = kids.groupBy("host", "node").agg((F.count_if(F.col("child") != "*") >= many).alias("has_many"), (F.sum("n") < seen * F.count("*")).alias("seldom"))
    vary = kids.where("has_many AND seldom").select("host", "node", F.lit("*").alias("any"))
    rows = rows.join(vary, ["host", "node"], "left").withColumn("child", F.coalesce("any", "child")).drop("any")
    nodes = rows.groupBy("host", "node", "child").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    # siblings of equal counts are alike: their classes are compared, so a node of many children is a window over few rows
    classes = nodes.groupBy("host", "node", "l", "b").agg(F.count("*").alias("children"))
    classes = classes.withColumn("share", (F.col("b") + 0.5) / (F.col("l") + 1.0)).withColumn("none", F.col("l") == 0)
    order = Window.partitionBy("host", "node", "none").orderBy("share", "l", "b")
    # in the order of their smoothed share: where neighbours differ significantly, a new branch begins; -1: no labelled pages
    classes = classes.withColumn("last", F.lag(F.struct("l", "b", "share")).over(order))
    pooled = (F.col("b") + F.col("last.b") + 1.0) / (F.col("l") + F.col("last.l") + 2.0)
    differs = F.col("share") - F.col("last.share") > Z * F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("l") + 1.0 / F.col("last.l")))
    branch = F.sum(F.when(~F.col("none") & differs, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    classes = classes.withColumn("branch", F.when(F.col("none"), -1).otherwise(branch).cast("int"))
    sums = classes.groupBy("host", "node", "branch").agg(F.sum(F.col("l") * F.col("children")).alias("ml"), F.sum(F.col("b") * F.col("children")).alias("mb"))
    of_class = classes.join(sums, ["host", "node", "branch"]).select("host", "node", "l", "b", "ml", "mb")
    of_child = nodes.join(of_class, ["host", "node", "l", "b"]).select("host", "node", "child", "ml", "mb")
    both = rows.join(of_child, ["host", "node", "child"])
    node = F.md5(F.concat("node", F.lit("/"), "child"))
    return both.select("host", "shape", node.alias("node"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), "n", "labelled", "blocked", smoothed(F.col("mb"), F.col("ml"), F.col("purity"), weight).alias("purity"), F.col("ml").alias("own"))


def purities(counts: DataFrame, weight: float = WEIGHT, many: int = MANY, seen: float = SEEN) -> DataFrame:
    """(host, shape, purity, own): of counts (host, shape, n, labelled, blocked), own the labelled pages of the shape's merged template."""
    total = counts.groupBy().agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = ((total["b"] or 0) + 1.0) / ((total["l"] or 0) + 2.0)
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("own"), F.sum("blocked").alias("b")).select("host", smoothed(F.col("b"), F.col("own"), F.lit(overall), weight).alias("purity"), "own")
    rest = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    rows = counts.join(hosts, "host").select("host", "shape", F.lit("").alias("node"), rest.alias("rest"), "n", "labelled", "blocked", "purity", "own")
    judged = []
    while True:
        at = stored(passed(rows, weight), f"url-tree-{len(judged)}")
        judged.append(at.where("size(rest) = 0").select("host", "shape", "purity", "own"))
        left = at.where("size(rest) > 0")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, judged)
        rows = branched(left, weight, many, seen)


def url_verdicts(pages: DataFrame, rules=RULES, reject: float = REJECT, sure: float = SURE) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity), one row per row of pages; purity is the tree's, for URLs without a rule too.

    A null URL or one without :// has an empty host and path, and is one of the tree's hosts like any other. Repeated rows
    count as often as they occur. Only page_id and url of pages are read. Paths may have any number of segments.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    counts = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    judged = purities(stored(counts, "url-counts")).select("host", "shape", "purity", (F.col("purity") > F.when(F.col("own") > 0, reject).otherwise(sure)).alias("rejected"))
    out = urls.join(judged, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), F.round("purity", 6).alias("purity"))


def url_sql(rules=RULES, reject: float = REJECT, sure: float = SURE, levels: int = SQL_LEVELS, many: int = MANY, seen: float = SEEN, weight: float = WEIGHT, pages: str = "pages") -> str:
    """DuckDB SQL for url_verdicts(); exact for paths of at most so many segments as levels."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    sql = f"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM {pages}),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    cuts AS (
        SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
            list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '^(?:[0-9a-fA-F-]{{16,}})$', '*'), '[0-9]+', '*', 'g')) AS segs FROM parts
    ),
    urls AS (SELECT * EXCLUDE (segs), array_to_string(segs, '/') AS shape FROM cuts),
    g0 AS (SELECT host, shape, string_split(shape, '/') AS segs, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, '' AS t0 FROM urls GROUP BY host, shape)"""
    for d in range(1, levels + 1):
        p = f"t{d - 1}"
        sql += f""",
    c{d} AS (SELECT *, CASE WHEN shape <> '' AND len(segs) >= {d} THEN segs[{d}] END AS child FROM g{d - 1}),
    v{d} AS (
        SELECT host, {p}, count(*) FILTER (child <> '*') >= {many} AND sum(n) < {float(seen)!r} * count(*) AS vary
        FROM (SELECT host, {p}, child, sum(n) AS n FROM c{d} WHERE child IS NOT NULL GROUP BY ALL) GROUP BY host, {p}
    ),
    g{d} AS (SELECT c{d}.* EXCLUDE (child), CASE WHEN child IS NULL THEN NULL ELSE concat({p}, '/', CASE WHEN vary THEN '*' ELSE child END) END AS t{d} FROM c{d} LEFT JOIN v{d} USING (host, {p}))"""
    sql += f""",
    p0 AS (SELECT *, (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) FROM g{levels}) AS purity, 0 AS own FROM g{levels})"""
    for d in range(levels + 1):
        up = f"t{d - 1}, m{d - 1}, " if d else ""
        sql += f""",
    s{d} AS (SELECT host, {up}t{d}, sum(labelled) AS l, sum(blocked) AS b FROM p{d} WHERE t{d} IS NOT NULL GROUP BY host, {up}t{d}),
    k{d} AS (
        SELECT host, {up}l, b, CASE WHEN l = 0 THEN -1 ELSE (sum(CASE WHEN share - ls > {Z}::DOUBLE * sqrt(q * (1.0::DOUBLE - q) * (1.0::DOUBLE / l + 1.0::DOUBLE / ll)) THEN 1 ELSE 0 END)
            OVER (PARTITION BY host, {up}l = 0 ORDER BY share, l, b ROWS UNBOUNDED PRECEDING))::INTEGER END AS m{d}
        FROM (SELECT *, (b + lb + 1.0::DOUBLE) / (l + ll + 2.0::DOUBLE) AS q FROM (
            SELECT *, lag(l) OVER w AS ll, lag(b) OVER w AS lb, lag(share) OVER w AS ls
            FROM (SELECT DISTINCT host, {up}l, b, (b + 0.5::DOUBLE) / (l + 1.0::DOUBLE) AS share FROM s{d}) WINDOW w AS (PARTITION BY host, {up}l = 0 ORDER BY share, l, b)))
    ),
    n{d} AS (SELECT s{d}.*, m{d} FROM s{d} JOIN k{d} USING (host, {up}l, b)),
    x{d} AS (SELECT host, {up}t{d}, m{d}, sum(l) OVER w AS ml, sum(b) OVER w AS mb FROM n{d} WINDOW w AS (PARTITION BY host, {up}m{d})),
    p{d + 1} AS (
        SELECT p{d}.* REPLACE (CASE WHEN ml IS NULL THEN purity ELSE (mb + {float(weight)!r}::DOUBLE * purity) / (ml + {float(weight)!r}::DOUBLE) END AS purity, coalesce(ml, own) AS own), m{d}
        FROM p{d} LEFT JOIN x{d} USING (host, {up}t{d})
    )"""
    return sql + f"""
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity > CASE WHEN own > 0 THEN {reject} ELSE {sure} END THEN 'block' ELSE 'allow' END) AS verdict, round(purity::DOUBLE, 6) AS purity
    FROM urls LEFT JOIN p{levels + 1} USING (host, shape)
    """
