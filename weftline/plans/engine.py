"""From a job to DataFrames: start addresses → policy → pages → records → details → repeats and marks → results.

Nothing runs before the result is asked for; the whole job is one lazy plan, except for pages that name their
successor (see :func:`weftline.operators.follow.walk_pages`). Field rules on HTML are evaluated in one Arrow pass
per page, those on JSON in one parse per item; defaults, transforms and everything after are JVM expressions.
Rows that break a rule (a required field is missing) go to ``rejects`` instead of stopping the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import hashing, htmlquery, jsonpath, transforms, urls
from weftline.operators import follow, incremental, quality
from weftline.operators.policy import RULES, Policy, decide, ranked
from weftline.shared import materialize
from weftline.sources import seeds


#: What records are ordered by: start address, page of it, item of the page.
ORDER = ("pos", "page_index", "item_pos")


@dataclass
class Result:
    """Frames of a run."""

    records: DataFrame
    rejects: DataFrame
    decisions: DataFrame
    index_delta: DataFrame | None = None
    watermark: DataFrame | None = None

    def quality(self, fields: list[str], required: list[str]) -> DataFrame:
        """Profile of the records' fields."""
        return quality.field_quality(self.records, fields, required)


def policy_of(config: dict, starts: DataFrame | None = None) -> Policy:
    """Limits of a job; none without an enabled policy. Without allowed domains the hosts of its start addresses are
    the scope, a bounded list (see :data:`weftline.operators.policy.RULES`)."""
    p = config.get("crawl_policy") or {}
    if not p.get("enabled"):
        return Policy(max_requests=1 << 60, max_depth=1 << 30, cross_domain=True, normalize=False)
    robots = p.get("robots") or {}
    allowed, cross = tuple(p.get("allowed_domains") or ()), bool(p.get("allow_cross_domain"))
    if not allowed and not cross and starts is not None:
        allowed = tuple(r[0] for r in starts.select(urls.host(F.col("url")).alias("h")).where("h is not null").distinct().limit(RULES + 1).collect())
    return Policy(
        max_requests=int(p.get("max_requests", 100)), max_depth=int(p.get("max_depth", 3)), allowed=allowed, denied=tuple(p.get("denied_domains") or ()), cross_domain=cross,
        include=tuple(p.get("include_url_patterns") or ()), exclude=tuple(p.get("exclude_url_patterns") or ()), normalize=p.get("normalize_url", True), remove_fragment=p.get("remove_fragment", True), remove_tracking=p.get("remove_tracking_params", True),
        tracking=tuple(p.get("tracking_params") or urls.TRACKING), robots=dict(robots.get("rules") or {}), robots_enabled=bool(robots.get("enabled")), robots_block=robots.get("mode") == "block", robots_unavailable=robots.get("unavailable_policy", "allow"), user_agent=p.get("user_agent") or "*",
    )


def _raw_json(rule: dict) -> bool:
    return rule.get("type", "css") == "json_path" or rule.get("type") == "children" and bool(rule.get("json_path"))


def _child_kind(rules: list[dict]) -> str:
    """Type of what child rules give: a list of structs of lists of texts."""
    return "array<struct<" + ", ".join(f"`{r['name']}`: {_child_kind(r['children']) if r.get('children') else 'array<string>'}" for r in rules) + ">>"


def _html_rule(r: dict) -> dict:
    rule = {"selector": "" if r.get("type") == "regex" else r.get("selector"), "xpath": r.get("xpath"), "attribute": r.get("attribute")}
    return rule | ({"children": {c["name"]: _html_rule(c) for c in r["children"]}} if r.get("children") else {})


def _json_rule(r: dict) -> object:
    path = r.get("json_path") or r.get("selector") or r["name"]
    return (path, {c["name"]: _json_rule(c) for c in r["children"]}) if r.get("children") else path


def extract(pages: DataFrame, config: dict) -> DataFrame:
    """``url, item_pos`` and one array column of raw values per field, of HTML pages or JSON answers; fields with
    children are arrays of structs of such arrays.

    JSON is taken where the job names the path of its items or has rules for JSON only, HTML otherwise.
    """
    rules: dict[str, dict] = {}
    for r in config.get("fields") or []:
        if r.get("type") != "static" and not (r.get("override") is False and r["name"] in rules):
            rules[r["name"]] = r
    typed = lambda got: got.withColumns({n: F.from_json(n, _child_kind(r["children"])) for n, r in rules.items() if r.get("children") and n in got.columns})
    path = config.get("items_json_path")
    if path is not None or rules and all(_raw_json(r) for r in rules.values()):
        items = pages.select("url", F.lit(0).alias("item_pos"), F.col("body").alias("item")) if path is None else jsonpath.items(pages, ["url"], "body", path)
        paths = {n: _json_rule(r) for n, r in rules.items() if _raw_json(r)}
        got = jsonpath.values(items, ["url", "item_pos"], "item", paths)
        as_list = lambda n: F.when(F.substring(n, 1, 1) == "[", F.from_json(n, "array<string>")).when(F.col(n).isNotNull(), F.array(F.from_json(F.concat(F.lit('{"v":'), F.col(n), F.lit("}")), "v string")["v"]))
        return typed(got.select("url", "item_pos", *[F.col(n) if rules[n].get("children") else as_list(n).alias(n) for n in paths]))
    return typed(htmlquery.extract(pages, "url", "body", {n: _html_rule(r) for n, r in rules.items() if not _raw_json(r)}, config.get("item_selector")))


def _field(found: Column, r: dict, source_url: Column) -> Column:
    """The value of a rule from what it found: first or all, defaults, transforms."""
    if r.get("type") == "static":
        return F.lit(r.get("value"))
    if r.get("children"):
        return _record(found, r, source_url)
    found = F.filter(found, lambda x: x.isNotNull() & (x != ""))
    if r.get("type") == "regex":
        found = transforms.regex_all(F.get(found, F.lit(0)), r["pattern"])
    is_array = bool(r.get("many"))
    value = F.when(F.size(found) > 0, found) if is_array else F.get(found, F.lit(0))
    value = _defaults(value, r, is_array)
    return transforms.apply_chain(value, r.get("transforms") or [], is_array, source_url, r.get("join_with"), strict=False)[0]


def _defaults(value: Column, r: dict, is_array: bool) -> Column:
    early = next((t.get("value", t.get("default")) for t in r.get("transforms") or [] if isinstance(t, dict) and t.get("type") == "default_if_empty"), None)
    for default in (early, r.get("default")):
        if default is not None:
            value = F.coalesce(value, F.array(*map(F.lit, default)) if is_array and isinstance(default, list) else F.array(F.lit(str(default))) if is_array else F.lit(str(default)))
    return value


def _record(found: Column, r: dict, source_url: Column) -> Column:
    """Child records: a struct of the first scope, or with ``many`` an array of structs of all; null without any.

    Inside an array the JVM works element by element; the transforms it cannot call there are applied to the values of
    a child over all scopes at once, which are then put together again.
    """
    rules = r["children"]
    fields = lambda s: F.struct(*[_field(s[c["name"]], c, source_url).alias(c.get("namespace") or c["name"]) for c in rules])
    if not r.get("many"):
        return F.when(F.size(found) > 0, fields(F.get(found, F.lit(0))))
    if not any(transforms.outside_jvm(c.get("transforms") or []) for c in rules):
        return F.when(F.size(found) > 0, F.transform(found, fields))
    child = lambda c: lambda s: F.lit(c.get("value")) if c.get("type") == "static" else _field(s[c["name"]], c, source_url)
    columns = []
    for c in rules:
        chain = c.get("transforms") or []
        outside = transforms.outside_jvm(chain)
        early = [t for t in chain if isinstance(t, dict) and t.get("type") == "default_if_empty"]
        one = F.transform(found, child({**c, "transforms": early} if outside else c))
        if outside:  # a child's value is single, so transforms of lists leave it as it is
            single = [t for t in chain if (t if isinstance(t, str) else t.get("type")) not in ("first", "last", "list_index", "join")]
            one = transforms.apply_chain(one, single, True, source_url, None, strict=False)[0]
        columns.append(one.alias(c.get("namespace") or c["name"]))
    return F.when(F.size(found) > 0, F.arrays_zip(*columns))


def project(raw: DataFrame, rules: list[dict], keep: list[str], source_url: Column) -> tuple[DataFrame, list[str]]:
    """Records from raw values: first or all, defaults, transforms, target names. Gives the names of required
    fields too. A default passes through the transforms; a rule with ``override: false`` leaves an earlier one."""
    columns: dict[str, Column] = {}
    required: list[str] = []
    for r in rules:
        name, target = r["name"], r.get("namespace") or r["name"]
        if r.get("override") is False and target in columns:
            continue
        value = _field(F.col(f"`{name}`") if r.get("type") != "static" else F.lit(None), r, source_url)
        columns[target] = value
        if r.get("required"):
            required.append(target)
    return raw.select(*keep, *[c.alias(n) for n, c in columns.items()]), required


def run(spark: SparkSession, config: dict, pages: DataFrame, index: DataFrame | None = None, bound: object = None, starts: DataFrame | None = None) -> Result:
    """Run a job over stored ``pages`` (``url, status_code, body``, one row per address). ``starts`` (``url, pos``, see
    :func:`weftline.sources.seeds.of_table`) stands for the start addresses of the job."""
    if starts is None:
        starts = seeds.start_urls(spark, config)
    p = config.get("pagination") or {}
    if p.get("urls"):
        listed = p["urls"][: int(p["max_pages"]) - 1] if p.get("max_pages") else p["urls"]
        more = seeds.inline(spark, listed).withColumn("pos", F.col("pos") + (1 << 40))
        starts = seeds.distinct_in_order(starts.unionByName(more), "url", "pos")
    decisions = decide(starts.withColumn("depth", F.lit(0)), "url", policy_of(config, starts), ["pos"], "depth")
    go = _paged(decisions.where("allowed").select(F.col("normalized_url").alias("url"), "pos"), pages, config)
    asked = go.join(pages.withColumnRenamed("url", "_u"), F.col("url") == F.col("_u"), "left").drop("_u")
    ok = asked.where("status_code between 200 and 299 and body is not null")
    failed = asked.where("status_code is null or status_code not between 200 and 299").select("url", F.when(F.col("status_code").isNull(), "network").otherwise("http_status").alias("error_type"))
    # addresses that become equal by normalization share a page: it is read once and stands at each of their positions
    read = pages.where("status_code between 200 and 299 and body is not null").join(go.select("url"), "url", "left_semi")
    raw = extract(read.select("url", "body"), config).join(ok.select("url", *ORDER[:2], "status_code"), "url")
    records, required = project(raw, config.get("fields") or [], ["url", *ORDER, "status_code"], F.col("url"))
    bad = F.lit(False)
    for n in required:
        bad = bad | F.col(f"`{n}`").isNull()
    rejects = failed.unionByName(records.where(bad).select("url", F.lit("field_required").alias("error_type")))
    records = records.where(~bad)
    if p.get("max_records"):
        records = ranked(records, list(ORDER), "_n").where(F.col("_n") <= int(p["max_records"])).drop("_n")
    for level in _details(config):
        records = _with_details(records, pages, level)
    out = Result(records, rejects, decisions)
    return _state(out, config, index, bound)


def _numbered(go: DataFrame, p: dict, param: str, first: Column, by: int) -> DataFrame:
    """Addresses of pages whose number stands in a parameter: all that a start may have, in one step."""
    size = p.get("page_size_param") if p.get("type") == "offset" and p.get("page_size") else None
    rows = go.withColumn("page_index", F.explode(F.sequence(F.lit(1), F.lit(int(p.get("max_pages", 1))))))
    number = (first + (F.col("page_index") - 1) * by).cast("string")
    params = F.create_map(F.lit(param), number, *([F.lit(size), F.lit(str(p["page_size"]))] if size else []))
    later = urls.add_params(urls.drop_query(F.col("url"), [param, size] if size else [param]), params)
    return rows.withColumn("url", F.when(F.col("page_index") == 1, F.col("url")).otherwise(later))


def _found(pages: DataFrame, config: dict, more: dict[str, str] | None = None) -> DataFrame:
    """``url, n`` and the values of further paths or selectors: how many items each page holds."""
    p, path = config.get("pagination") or {}, config.get("items_json_path")
    if path is not None or p.get("type") == "cursor":
        got = jsonpath.values(pages, ["url"], "body", {"_items": path or "$", **(more or {})})
        n = F.when(F.col("_items").isNull(), 0).when(F.substring("_items", 1, 1) == "[", F.size(F.from_json("_items", "array<string>"))).otherwise(1)
        text = lambda c: F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "v string")["v"]
        return got.select("url", n.alias("n"), *[text(c).alias(c) for c in more or {}])
    item = config.get("item_selector")
    rules = {c: {"selector": x, "attribute": p.get("next_attribute")} for c, x in (more or {}).items()} | ({"_items": {"selector": item}} if item else {})
    if not rules:
        return pages.select("url", F.lit(1).alias("n"))
    got = htmlquery.extract(pages, "url", "body", rules)
    return got.select("url", (F.size("_items") if item else F.lit(1)).alias("n"), *[F.get(c, F.lit(0)).alias(c) for c in more or {}])


def _paged(go: DataFrame, pages: DataFrame, config: dict) -> DataFrame:
    """``url, pos, page_index``: the pages that a job asks for, from each start address on.

    Pages whose addresses are known beforehand (``page``, and ``offset`` with a page size) are all looked up at once, and
    those after the first page without items are left out. Pages that name their successor, or whose size decides the
    next offset, are followed hop by hop, all start addresses together.
    """
    p = config.get("pagination") or {}
    kind, most = p.get("type", "none"), int(p.get("max_pages", 1))
    if kind in ("none", "url_list", None) or most < 2 and kind != "next_button":
        return go.withColumn("page_index", F.lit(1))
    readable = pages.where("status_code between 200 and 299 and body is not null").select("url", "body")
    param = p.get("offset_param") or "offset" if kind == "offset" else p.get("page_param") or ("cursor" if kind == "cursor" else "page")
    if kind == "page" or kind == "offset" and p.get("page_size"):
        start = urls.int_param(F.col("url"), param)
        first = F.coalesce(F.nullif(start, F.lit(0)), F.lit(1)) if kind == "page" else F.coalesce(start, F.lit(0))
        every = _numbered(go, p, param, first, 1 if kind == "page" else int(p["page_size"]))
        n = _found(readable.join(every.select("url").distinct(), "url", "left_semi"), config)
        at = materialize(every.join(n.groupBy("url").agg(F.max("n").alias("n")), "url", "left"), "paged")
        ends = at.where("coalesce(n, 0) = 0").groupBy("pos").agg(F.min("page_index").alias("_end"))
        return at.join(ends, "pos", "left").where("_end is null or page_index <= _end").select("url", "pos", "page_index")

    def step(frontier: DataFrame) -> DataFrame:
        """Next pages of those that hold items."""
        here = readable.join(frontier.select("url").distinct(), "url", "left_semi")
        if kind == "next_button":
            got = _found(here, config, {"next": p["next_selector"]})
            nxt = urls.join(F.col("url"), F.col("next"))
        elif kind == "offset":
            got, url = _found(here, config), F.col("url")
            size = F.coalesce(F.nullif(urls.int_param(url, p["page_size_param"]), F.lit(0)), F.col("n")) if p.get("page_size_param") else F.col("n")
            at = (F.coalesce(urls.int_param(url, param), F.lit(0)) + size).cast("string")
            nxt = urls.add_params(urls.drop_query(url, [param]), F.create_map(F.lit(param), at))
        else:
            paths = {c: p[k] for c, k in (("next", "next_json_path"), ("cursor", "cursor_json_path")) if p.get(k)}
            got = _found(here, config, paths)
            by_cursor = F.when(F.col("cursor") != "", urls.add_params(urls.drop_query(F.col("url"), [param]), F.create_map(F.lit(param), F.col("cursor")))) if "cursor" in paths else F.lit(None)
            nxt = F.coalesce(urls.join(F.col("url"), F.nullif(F.col("next"), F.lit(""))) if "next" in paths else F.lit(None).cast("string"), by_cursor)
        return frontier.join(got.where("n > 0").select("url", nxt.alias("_next")), "url").select("source", F.col("_next").alias("url"))

    walked = follow.walk_pages(go.select(F.col("pos").alias("source"), "url"), step, most)
    return walked.select("url", F.col("source").alias("pos"), "page_index")


def _details(config: dict) -> list[dict]:
    out, d = [], config.get("detail")
    while isinstance(d, dict):
        out.append(d)
        d = d.get("detail")
    return out


def _with_details(records: DataFrame, pages: DataFrame, level: dict) -> DataFrame:
    link = level["url_field"]
    one = F.col(f"`{link}`")
    links = one if records.schema[link].dataType.simpleString().startswith("array") else F.array(one)
    records = records.withColumn("_links", F.transform(F.filter(links, lambda u: u.isNotNull()), lambda u: u))
    wanted = records.select(F.explode("_links").alias("ref"), F.col("url").alias("base")).select(urls.join(F.col("base"), F.col("ref")).alias("url"), "ref").distinct()
    page = wanted.join(pages.where("status_code between 200 and 299").select("url", "body"), "url")
    got, _ = project(extract(page.select(F.col("ref").alias("url"), "body"), {"fields": level.get("fields") or []}), level.get("fields") or [], ["url"], F.col("url"))
    fields = [c for c in got.columns if c != "url"]
    merged = follow.follow(records, list(ORDER), F.col("_links"), got.withColumnRenamed("url", "_page_url"), "_page_url", fields, level.get("merge", "override"), level.get("namespace", "detail"))
    return merged.drop("_links")


def _state(out: Result, config: dict, index: DataFrame | None, bound: object) -> Result:
    records = out.records
    d, w = config.get("dedup") or {}, config.get("watermark") or {}
    if w.get("enabled"):
        raw = F.col(f"`{w['field']}`")
        kinds = {"int": "bigint", "float": "double", "datetime": "timestamp"}
        value = raw.try_cast(kinds[w["type"]]) if w.get("type") in kinds else raw.cast("string")
        fresh = incremental.newer(value, bound, w.get("strategy", "max"))
        if w.get("stop_when_older"):  # the first page with an older record is the last one of its start address
            last = records.where(~F.coalesce(fresh, F.lit(True))).groupBy("pos").agg(F.min("page_index").alias("_last"))
            records = records.join(last, "pos", "left").where("_last is null or page_index <= _last").drop("_last")
        records = records.where(fresh)
    keys = d.get("keys") or d.get("fields") or config.get("unique_fields") or []
    if (d.get("enabled") if "enabled" in d else bool(keys)) and keys:
        policy = d.get("missing_key_policy", "error")
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.col(f"`{k}`").isNull()
        if policy == "skip":
            records = records.where(~missing)
        digest = hashing.record_hash({k: (F.col(f"`{k}`"), records.schema[k].dataType) for k in keys}, d.get("hash_method", "sha256"))
        if policy == "error":
            digest = F.when(missing, F.raise_error(F.lit(f"missing dedup key of {keys}"))).otherwise(digest)
        records = records.withColumn("unique_hash", digest)
        known = index if index is not None else records.sparkSession.createDataFrame([], "unique_hash string")
        if d.get("skip_existing", True):
            records = incremental.new_rows(records, ["unique_hash"], list(ORDER), known)
        else:
            records = incremental.mark_repeats(records, ["unique_hash"], list(ORDER), known)
        out.index_delta = incremental.index_delta(records, ["unique_hash"], known)
    if w.get("enabled"):
        out.watermark = incremental.candidate(records, value, raw.cast("string"), w.get("strategy", "max"))
    out.records = records.withColumns({"source_url": F.col("url"), "response_status": F.col("status_code"), "spider_id": F.lit(config["id"])}).drop("url", "status_code")
    return out


def explain(spark: SparkSession, config: dict) -> dict:
    """What a job would do: its decisions and the number of requests at most."""
    from weftline.operators.policy import estimate, summary

    starts = seeds.start_urls(spark, config)
    limits = policy_of(config, starts)
    d = decide(starts.withColumn("depth", F.lit(0)), "url", limits, ["pos"], "depth")
    row = summary(d, "url").first().asDict()
    p = config.get("pagination") or {}
    row["estimated_requests"] = estimate(row["policy_checked_urls"], int(p.get("max_pages", 1)), p.get("max_records"), bool(config.get("detail")), limits)
    return row
