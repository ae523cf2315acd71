"""URL filtering by rules and by a path-template tree learned from labelled pages, in built-in functions only.

The tree grows one path segment at a time. A segment that is rare below its parent is variable and becomes a wildcard. A frequent one
stays apart only if its labels differ from its siblings' by a two-proportion test; branches that look alike are merged into the
wildcard. A page is judged by the smoothed share of bad labels of its template: towards its host's share, which leans on the overall one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import ascii_lower, plain

#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEPTH = 8  # segments that the tree tells apart; what lies deeper is one last segment
LEAST, SHARE = 20, 0.02  # pages, and share of its parent's pages, from which a segment is a literal
Z2 = 3.84  # squared z value from which a branch differs
SMOOTHING, PURITY = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand after the first ``://``; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else nulls. For lists that a person writes: it is one conditional."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    every = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(every) > DEPTH, F.concat(F.slice(every, 1, DEPTH - 1), F.array(F.array_join(F.slice(every, DEPTH, F.greatest(F.lit(1), F.size(every))), "/")))).otherwise(every)


def _literals(paths: DataFrame) -> DataFrame:
    """(host, template, segment) of the branches that stay apart; only segments with LEAST pages or more are looked at again."""
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    below = paths.where("segment is not null").groupBy("host", "template", "segment").agg(*sums)
    whole = below.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")])
    both = below.where(F.col("n") >= LEAST).join(whole, ["host", "template"]).where(F.col("n") >= SHARE * F.col("all_n"))
    m, m_rest = (F.col("bad") + F.col("good")).cast("double"), (F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")).cast("double")
    share, rest = F.try_divide("bad", m), F.try_divide(F.col("all_bad") - F.col("bad"), m_rest)
    pooled = F.try_divide("all_bad", m + m_rest)
    apart = (share - rest) * (share - rest) > Z2 * pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), m) + F.try_divide(F.lit(1.0), m_rest))
    return both.where(F.coalesce(apart, F.lit(False))).select("host", "template", "segment", F.lit(True).alias("literal"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, path, template, bad, good) of the distinct addresses; ``pages`` has host, path, and bad and good as 0 or 1."""
    paths = cut(pages.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumns({"parts": segments(F.col("path")), "template": F.lit("")}))
    for level in range(paths.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]):
        here = paths.withColumn("segment", F.get("parts", F.lit(level)))
        named = here.join(_literals(here), ["host", "template", "segment"], "left")
        step = F.when(F.col("segment").isNull(), "").when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        paths = cut(named.withColumn("template", F.concat("template", step)).select("host", "path", "n", "bad", "good", "parts", "template"))
    return paths.select("host", "path", "template", "bad", "good")


def blocked_templates(tree: DataFrame, purity: float = PURITY) -> DataFrame:
    """(host, template, blocked) by the smoothed share of bad labels."""
    of = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    hosts = of.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum(F.col("bad") + F.col("good")).alias("host_n"))
    over_all = of.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum(F.col("bad") + F.col("good"))), F.lit(0.0))).first()[0]
    near = (F.col("host_bad") + SMOOTHING * over_all) / (F.col("host_n") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * near) / (F.col("bad") + F.col("good") + SMOOTHING)
    return of.join(hosts, "host").select("host", "template", (share >= purity).alias("blocked"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, purity: float = PURITY, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and template.

    ``labels`` has page_id and bad (1 bad, 0 good); a page with several labels counts as bad if one says so. A rule's verdict goes before
    the tree's. Null addresses and those without ``://`` have an empty host and path and the empty template. Repeated pages give repeated
    rows, and their labels count each time; a null id is judged but has no label; an empty table gives an empty result; without labels
    the tree allows everything.
    """
    marks = plain(labels, page_id="page_id", bad="bad").where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    host, path = host_and_path(F.col("url"))
    parsed = cut(plain(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path")).join(marks, "page_id", "left"))
    tree = cut(templates(parsed.select("host", "path", F.coalesce(F.col("bad"), F.lit(0)).alias("bad"), F.coalesce(1 - F.col("bad"), F.lit(0)).alias("good"))))
    verdicts = tree.select("host", "path", "template").join(blocked_templates(tree, purity), ["host", "template"])
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    return parsed.select("page_id", "host", "path").join(verdicts, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template")


def shown_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages whose address ends with the number of a labelled document: bad if toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(split(url, '[?#]')[0], '([0-9]+)[^0-9]*$', 1) AS bigint)")
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("page_id", number.alias("doc_id")).join(marks, "doc_id").select("page_id", "bad")


def verdict_sql() -> str:
    """The same in DuckDB: every level of the tree as one more step."""
    steps, last = [], "p0"
    for level in range(1, DEPTH + 1):
        steps.append(f"""
c{level} AS (SELECT host, template, parts[{level}] AS segment, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM {last} WHERE len(parts) >= {level} GROUP BY ALL),
w{level} AS (SELECT host, template, sum(n) AS all_n, sum(bad) AS all_bad, sum(good) AS all_good FROM c{level} GROUP BY ALL),
l{level} AS (SELECT host, template, segment FROM (SELECT *, CAST(bad + good AS DOUBLE) AS m, CAST(all_bad + all_good - bad - good AS DOUBLE) AS r FROM c{level} JOIN w{level} USING (host, template))
  WHERE n >= {LEAST} AND n >= {SHARE} * all_n AND m > 0 AND r > 0
    AND (bad / m - (all_bad - bad) / r) * (bad / m - (all_bad - bad) / r) > {Z2} * (all_bad / (m + r)) * (1 - all_bad / (m + r)) * (1.0 / m + 1.0 / r)),
p{level} AS (SELECT {last}.host, path, n, bad, good, parts, {last}.template || CASE WHEN len(parts) < {level} THEN '' WHEN l{level}.segment IS NOT NULL THEN '/' || parts[{level}] ELSE '/*' END AS template
  FROM {last} LEFT JOIN l{level} ON {last}.host = l{level}.host AND {last}.template = l{level}.template AND parts[{level}] = l{level}.segment)""")
        last = f"p{level}"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " WHEN blocked THEN 'block' ELSE 'allow' END"
    return f"""WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  TRY_CAST(regexp_extract(regexp_extract(url, '^[^?#]*'), '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS doc_id FROM rests),
joined AS (SELECT page_id, host, path, coalesce(bad, 0) AS bad, coalesce(1 - bad, 0) AS good FROM parsed LEFT JOIN marks USING (doc_id)),
g0 AS (SELECT host, path, count(*) AS n, sum(bad) AS bad, sum(good) AS good, [x FOR x IN string_split(path, '/') IF x <> ''] AS every FROM joined GROUP BY host, path),
p0 AS (SELECT host, path, n, bad, good, CASE WHEN len(every) > {DEPTH} THEN list_append(every[1:{DEPTH - 1}], array_to_string(every[{DEPTH}:], '/')) ELSE every END AS parts, '' AS template FROM g0),{','.join(steps)},
t AS (SELECT host, template, sum(bad) AS bad, sum(good) AS good FROM {last} GROUP BY ALL),
h AS (SELECT host, sum(bad) AS host_bad, sum(bad + good) AS host_n FROM t GROUP BY 1),
o AS (SELECT coalesce(sum(bad) / nullif(sum(bad + good), 0), 0.0) AS over_all FROM t),
v AS (SELECT t.host, template, (bad + {SMOOTHING} * ((host_bad + {SMOOTHING} * over_all) / (host_n + {SMOOTHING}))) / (bad + good + {SMOOTHING}) >= {PURITY} AS blocked FROM t JOIN h USING (host) CROSS JOIN o)
SELECT page_id, host, path, {name} AS rule, {verdict} AS verdict, template FROM joined JOIN (SELECT host, path, template FROM {last}) USING (host, path) JOIN v USING (host, template)"""
