"""URL filter by rules and by link-graph propagation.

A url's host and path are matched against a short rule list (longest rule wins).  Urls that no rule fits are
judged by their host: pages that rules allow are trusted seeds, pages that rules block are distrust seeds.
Trust is a personalised PageRank from the trusted hosts along the links between hosts; distrust is the
same from the blocked hosts against the links' direction, so that who links to blocked hosts is
distrusted.  A host whose distrust exceeds ``THRESHOLD`` times its trust is blocked.

Everything is DataFrame operations.  Links are counted per host pair before the shuffle, links inside a host
carry no endorsement and are left out, and each round is one join and one sum over host pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored

#: The production rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MOST_RULES = 500
DAMPING = 0.85
ROUNDS = 16
THRESHOLD = 1.0
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without it empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by_rules(host: F.Column, path: F.Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[F.Column, F.Column]:
    """``(rule, verdict)`` of the longest rule that fits, null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, links``: links between different hosts of ``pages(url, html)``.  A link without a host stays on
    its own host; other schemes (``mailto:``) and empty hosts count as none."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    absolute = F.when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("link")).when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link"))
    there = found.select("src", host_of(absolute).alias("dst")).filter("dst <> '' and src <> '' and src <> dst")
    return there.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` of every host with some of either.  ``seeds(host, trust, distrust)``: seed weights;
    each column is scaled to the sum 1.  A host's score goes out over its links in shares of their counts;
    what a host without links would send is lost."""
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trust").cast("double").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.col("distrust").cast("double").alias("seed")),
    )).alias("x")).select("host", "x.kind", "x.seed").filter("seed > 0")
    sums = start.groupBy("kind").agg(F.sum("seed").alias("all"))  # two rows
    start = checkpointed(start.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")))
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").unionAll(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    )
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    edges = checkpointed(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("part")))
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    score = start.select("kind", "host", F.col("seed").alias("score"))
    if not edges.limit(1).count():  # nothing to send: the scores are the seeds'
        rounds = 0
    for r in range(rounds):
        sent = score.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        score = base.unionAll(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if r % 4 == 3:
            score = checkpointed(score)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    return score.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ..)``: ``page_id, host, path, rule, verdict`` and the host's
    ``trust`` and ``distrust``.

    A null url or one without ``://`` has an empty host and path; no rule fits it, it has no score and is allowed, as
    is any host that neither trust nor distrust reaches.  Null html has no links.  Repeated rows count as pages
    of their own; other columns are ignored; an empty table gives none."""
    rows = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = judged_by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    seeds = rows.groupBy("host").agg(
        F.sum((F.col("by_rule") == "allow").cast("int")).alias("trust"), F.sum((F.col("by_rule") == "block").cast("int")).alias("distrust")
    )
    seeds = seeds.select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")).filter("host <> ''")
    hosts = propagate(seeds, stored(host_links(pages), "host-links"))
    blocked = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    return rows.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def _oracle() -> str:
    """The same in DuckDB SQL; the rounds are written out one by one."""
    cases = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in cases)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in cases)
    lower = f"translate(regexp_extract({{}}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    link = LINK.replace(r"\"", '"').replace("'", "''")
    rounds = "\n".join(
        f"""r{k} as (select kind, host, sum(score) as score from (
  select kind, host, seed * (1 - {DAMPING}) as score from s
  union all select r.kind, e.dst, r.score * e.part * {DAMPING} from r{k - 1} r join e on r.kind = e.kind and r.host = e.host) group by all),"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""
with p as materialized (
  select page_id, coalesce({lower.format('url')}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages),
j as materialized (select page_id, host, path, case {rule} end as rule, case {verdict} end as by_rule from p),
l as materialized (
  select host as src, coalesce({lower.format("case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then 'x:' || link end")}, '') as dst
  from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as link from p)),
c as (select src, dst, count(*) as links from l where src <> '' and dst <> '' and src <> dst group by all),
b as (select 'trust' as kind, src as host, dst, links from c union all select 'distrust', dst, src, links from c),
e as materialized (select kind, host, dst, links / sum(links) over (partition by kind, host) as part from b),
w as (
  select 'trust' as kind, host, count(*) as seed from j where by_rule = 'allow' and host <> '' group by host
  union all select 'distrust', host, count(*) from j where by_rule = 'block' and host <> '' group by host),
s as materialized (select kind, host, seed / sum(seed) over (partition by kind) as seed from w),
r0 as (select kind, host, seed as score from s),
{rounds}
f as (select kind, host, score from {{last}}),
h as (select host, coalesce(sum(score) filter (kind = 'trust'), 0.0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0.0) as distrust from f group by host)
select j.page_id, j.host, j.path, j.rule,
       coalesce(j.by_rule, case when coalesce(h.distrust > {THRESHOLD} * h.trust, false) then 'block' else 'allow' end) as verdict,
       coalesce(h.trust, 0.0) as trust, coalesce(h.distrust, 0.0) as distrust
from j left join h on j.host = h.host
""".replace("{last}", f"(select * from r{ROUNDS} where exists (select 1 from e) union all select * from r0 where not exists (select 1 from e))")


ORACLE = _oracle()
