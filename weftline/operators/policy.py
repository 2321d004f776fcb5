"""Which addresses may be fetched: budget, scope, patterns and robots, all checked for every address.

Every check adds to a list of violations (or warnings) instead of cutting the others short, so the decision
table says everything that is wrong with an address. Domain lists and robots rules are configuration, bounded by
:data:`RULES`; they are literals of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import urls
from weftline.functions.transforms import java_pattern

#: Most domains and robots texts a policy may hold.
RULES = 10_000


@dataclass(frozen=True)
class Policy:
    """Limits of a crawl."""

    max_requests: int = 100
    max_depth: int = 3
    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()
    cross_domain: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    normalize: bool = True
    remove_fragment: bool = True
    remove_tracking: bool = True
    tracking: tuple[str, ...] = urls.TRACKING
    robots: dict[str, str] = field(default_factory=dict)
    robots_enabled: bool = False
    robots_block: bool = False
    robots_unavailable: str = "allow"
    user_agent: str = "*"

    def __post_init__(self) -> None:
        if len(self.allowed) + len(self.denied) + len(self.robots) > RULES:
            raise ValueError(f"a policy holds at most {RULES} rules")


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is, or lies below, one of the domains: one lookup per parent domain of the host, however
    many domains there are."""
    if not domains:
        return F.lit(False)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.exists(parents, lambda p: p.isin(list(domains)))


def is_local(host: Column) -> Column:
    """Hosts that have no robots rules."""
    return host.isin("localhost", "127.0.0.1", "::1") | host.endswith(".test")


def _robots_status(policy: Policy) -> object:
    rules, agent = policy.robots, policy.user_agent

    @F.pandas_udf(T.StringType())
    def status(host: pd.Series, url: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser | None] = {}

        def find(h: str) -> RobotFileParser | None:
            if h not in parsed:
                text = rules.get(h) or next((t for d, t in rules.items() if h == d or h.endswith("." + d)), None)
                parser = None
                if text is not None:
                    parser = RobotFileParser()
                    parser.parse(text.splitlines())
                parsed[h] = parser
            return parsed[h]

        return pd.Series(["unavailable" if (p := find(h)) is None else "allowed" if p.can_fetch(agent, u) else "disallowed" for h, u in zip(host, url)], dtype=object)

    return status


def decide(requests: DataFrame, url: str, policy: Policy, order: list[str], depth: str | None = None) -> DataFrame:
    """``requests`` with ``normalized_url, host, violations, warnings, robots, allowed``.

    ``order`` says in which order addresses are checked, as every check counts against the budget. The budget
    needs one running number over all requests; :func:`ranked` gives it without a single-partition window.
    """
    normal = urls.normalize(F.col(url), policy.remove_fragment, policy.remove_tracking, policy.tracking) if policy.normalize else F.col(url)
    rows = ranked(requests, order, "check_no").withColumn("normalized_url", normal).withColumn("host", urls.host(F.col("normalized_url")))
    host, u = F.col("host"), F.col("normalized_url")
    denied, inside = in_domains(host, policy.denied), in_domains(host, policy.allowed)
    outside = host.isNotNull() & ~denied & F.lit(not policy.cross_domain and bool(policy.allowed)) & ~inside
    any_of = lambda ps: F.lit(False) if not ps else u.rlike("|".join(f"(?:{java_pattern(p)})" for p in ps))
    checks = [
        F.when(F.col("check_no") > policy.max_requests, F.lit(f"max_requests exceeded: {policy.max_requests}")),
        F.when(F.col(depth) > policy.max_depth, F.lit(f"max_depth exceeded: {policy.max_depth}")) if depth else F.lit(None).cast("string"),
        F.when(host.isNotNull() & denied, F.concat(F.lit("denied domain: "), host)),
        F.when(outside, F.concat(F.lit("outside allowed domain scope: "), host)),
        F.when(~any_of(policy.include), F.lit("url did not match include_url_patterns")) if policy.include else F.lit(None).cast("string"),
        F.when(any_of(policy.exclude), F.lit("url matched exclude_url_patterns")),
    ]
    warnings: list[Column] = []
    if policy.robots_enabled:
        asked = host.isNotNull() & urls.scheme(u).isin("http", "https") & ~is_local(host)
        rows = rows.withColumn("robots", F.when(asked, _robots_status(policy)(F.coalesce(host, F.lit("")), F.coalesce(u, F.lit("")))).otherwise("skipped_local"))
        missing = F.when(F.col("robots") == "unavailable", F.concat(F.lit("robots unavailable for "), host))
        barred = F.when(F.col("robots") == "disallowed", F.concat(F.lit("robots disallow for "), host, F.lit(": "), u))
        checks += [missing] if policy.robots_unavailable == "block" else []
        warnings += [missing] if policy.robots_unavailable == "warn" else []
        (checks if policy.robots_block else warnings).append(barred)
    else:
        rows = rows.withColumn("robots", F.lit("disabled"))
    listed = lambda cs: F.array_compact(F.array(*cs)) if cs else F.expr("cast(array() as array<string>)")
    return rows.withColumn("violations", listed(checks)).withColumn("warnings", listed(warnings)).withColumn("allowed", F.size("violations") == 0)


def summary(decisions: DataFrame, url: str) -> DataFrame:
    """One row of counters of a decision table."""
    return decisions.agg(
        F.count("*").alias("policy_checked_urls"), F.count_if(~F.col("allowed")).alias("policy_blocked_urls"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("policy_warnings"), F.count_if(F.col("normalized_url") != F.col(url)).alias("normalized_urls")
    )


def ranked(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with its global position in ``order``, computed in parallel.

    A window without partition would bring all rows into one task. Instead the rows are range partitioned and sorted
    once, a row's place in its partition is read off its running id, and the counts of the partitions before are added:
    the only thing that is looked at as a whole is one number per partition. Rows that are equal in ``order`` are numbered
    as they fall, so it should be unique.
    """
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    # the id holds the partition above bit 33 and the place in it, from 0, below
    numbered = placed.withColumn("_part", F.shiftright("_row", 33)).withColumn("_in", F.col("_row").bitwiseAND((1 << 33) - 1) + 1)
    sizes = numbered.groupBy("_part").agg(F.max("_in").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") + F.col("_before") + F.lit(start - 1)).cast("bigint")).drop("_part", "_row", "_in", "_before")


def estimate(urls_: int, pages: int, max_records: int | None, detail: bool, policy: Policy) -> int:
    """Requests a job will make at most."""
    listing = max(1, urls_) * max(1, pages)
    return min(policy.max_requests, listing + ((max_records or listing) if detail else 0))
