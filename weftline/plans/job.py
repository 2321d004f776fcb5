"""Job configuration: the declarative document that says where pages come from and what becomes of them.

``load`` brings older spellings to the present ones and checks everything, collecting all problems with their
paths instead of stopping at the first.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from weftline.functions import transforms
from weftline.operators.schedule import parse_cron

# Option vocabularies of job files.
FIELD_TYPES = ("css", "attribute", "xpath", "regex", "json_path", "static", "children")
PAGINATION = ("none", "page", "offset", "next_button", "cursor", "url_list")
RESPONSES = ("html", "text", "json", "binary")
MISSING_KEYS = ("error", "warn", "skip", "allow_empty")
DEDUP_SCOPES = ("global", "spider", "task")
MERGES = ("override", "namespace", "keep_list")
SCHEDULES = ("manual", "interval", "cron")
MISFIRES = ("skip", "run_once", "catch_up")
EXPORTS = ("json", "jsonl", "csv", "xlsx")
RENAMED = {"schema_version": "version", "mode": "type", "schedule": "scheduler"}


class ConfigError(ValueError):
    """All problems of a configuration as (path, message)."""

    def __init__(self, issues: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{p}: {m}" for p, m in issues))
        self.issues = issues


def canonical(config: dict) -> dict:
    """The configuration under present names; a present name goes before an older one."""
    out = dict(config)
    for old, new in RENAMED.items():
        if old in out:
            value = out.pop(old)
            out.setdefault(new, value)
    return out


def deep_merge(base: dict, extra: dict) -> dict:
    """Objects are merged, everything else replaced."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


class _Check:
    def __init__(self) -> None:
        self.issues: list[tuple[str, str]] = []

    def add(self, path: str, message: str) -> None:
        self.issues.append((path, message))

    def one_of(self, obj: dict, key: str, allowed: tuple, path: str) -> None:
        if obj.get(key) is not None and obj[key] not in allowed:
            self.add(f"{path}.{key}".lstrip("."), f"must be one of {', '.join(map(str, allowed))}")

    def number(self, obj: dict, key: str, path: str, least: float = 0) -> None:
        v = obj.get(key)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < least):
            self.add(f"{path}.{key}".lstrip("."), f"must be a number of at least {least:g}")

    def pattern(self, text: object, path: str) -> None:
        try:
            re.compile(str(text))
        except re.error as e:
            self.add(path, f"bad pattern: {e}")

    def fields(self, rules: object, path: str) -> None:
        if not isinstance(rules, list):
            self.add(path, "must be a list")
            return
        for i, r in enumerate(rules):
            at = f"{path}[{i}]"
            if not isinstance(r, dict):
                self.add(at, "must be an object")
                continue
            if not isinstance(r.get("name"), str) or not r["name"]:
                self.add(f"{at}.name", "is required")
            self.one_of(r, "type", FIELD_TYPES, at)
            kind = r.get("type", "css")
            need = {"css": "selector", "attribute": "selector", "xpath": "xpath", "regex": "pattern", "json_path": "json_path", "children": "children"}.get(kind)
            if need and not r.get(need):
                self.add(f"{at}.{need}", f"is required for {kind}")
            if kind == "attribute" and not r.get("attribute"):
                self.add(f"{at}.attribute", "is required for attribute")
            if r.get("pattern"):
                self.pattern(r["pattern"], f"{at}.pattern")
            for k, t in enumerate(r.get("transforms") or []):
                name = t if isinstance(t, str) else t.get("type") if isinstance(t, dict) else None
                if name not in transforms.names():
                    self.add(f"{at}.transforms[{k}]", f"unknown transform {name}")
                elif isinstance(t, dict) and t.get("pattern"):
                    self.pattern(t["pattern"], f"{at}.transforms[{k}].pattern")
            if r.get("children"):
                if kind not in ("css", "xpath", "json_path", "children"):
                    self.add(f"{at}.type", f"{kind} has no children")
                self.fields(r["children"], f"{at}.children")


def check(config: dict) -> list[tuple[str, str]]:
    """Problems of a configuration in canonical form."""
    c = _Check()
    if not isinstance(config.get("id"), str) or not config["id"]:
        c.add("id", "is required")
    if not (config.get("start_urls") or (config.get("request") or {}).get("url") or config.get("seed")):
        c.add("start_urls", "a job needs start_urls, request.url or seed")
    c.fields(config.get("fields") or [], "fields")
    section = lambda name: config.get(name) if isinstance(config.get(name), dict) else {}
    for name in ("request", "pagination", "dedup", "watermark", "scheduler", "crawl_policy", "export", "rate_limit", "concurrency", "retry"):
        if config.get(name) is not None and not isinstance(config[name], dict):
            c.add(name, "must be an object")
    c.one_of(section("request"), "response_type", RESPONSES, "request")
    p = section("pagination")
    c.one_of(p, "type", PAGINATION, "pagination")
    for k in ("max_pages", "max_records", "page_size"):
        c.number(p, k, "pagination", 1)
    if p.get("type") == "next_button" and not p.get("next_selector"):
        c.add("pagination.next_selector", "is required for next_button")
    if p.get("type") == "cursor" and not (p.get("next_json_path") or p.get("cursor_json_path")):
        c.add("pagination.next_json_path", "cursor needs next_json_path or cursor_json_path")
    if p.get("urls") and p.get("type") not in (None, "none", "url_list"):
        c.add("pagination.urls", f"cannot be combined with {p['type']}")
    d = section("dedup")
    c.one_of(d, "missing_key_policy", MISSING_KEYS, "dedup")
    c.one_of(d, "scope", DEDUP_SCOPES, "dedup")
    c.one_of(d, "hash_method", ("sha256", "md5"), "dedup")
    if d.get("enabled") and not (d.get("keys") or d.get("fields") or config.get("unique_fields")):
        c.add("dedup.keys", "are required when dedup is enabled")
    w = section("watermark")
    c.one_of(w, "strategy", ("max", "min"), "watermark")
    c.one_of(w, "type", ("string", "int", "float", "datetime"), "watermark")
    if w.get("enabled") and not w.get("field"):
        c.add("watermark.field", "is required when watermark is enabled")
    s = section("scheduler")
    c.one_of(s, "type", SCHEDULES, "scheduler")
    c.one_of(s, "misfire_policy", MISFIRES, "scheduler")
    c.number(s, "interval_seconds", "scheduler", 1)
    c.number(s, "jitter_seconds", "scheduler")
    if s.get("type") == "cron":
        try:
            parse_cron(str(s.get("cron", "")))
        except ValueError as e:
            c.add("scheduler.cron", str(e))
    y = section("crawl_policy")
    for k in ("include_url_patterns", "exclude_url_patterns"):
        for i, text in enumerate(y.get(k) or []):
            c.pattern(text, f"crawl_policy.{k}[{i}]")
    for k in ("max_requests", "max_depth"):
        c.number(y, k, "crawl_policy")
    for i, fmt in enumerate(section("export").get("formats") or []):
        if fmt not in EXPORTS:
            c.add(f"export.formats[{i}]", f"must be one of {', '.join(EXPORTS)}")
    c.number(section("rate_limit"), "requests_per_second", "rate_limit")
    c.number(section("concurrency"), "max_workers", "concurrency", 1)
    c.number(section("retry"), "max_attempts", "retry", 1)
    detail, at = config.get("detail"), "detail"
    while isinstance(detail, dict):
        c.fields(detail.get("fields") or [], f"{at}.fields")
        c.one_of(detail, "merge", MERGES, at)
        if not (detail.get("url_field") or detail.get("url_selector")):
            c.add(f"{at}.url_field", "a detail needs url_field or url_selector")
        detail, at = detail.get("detail"), f"{at}.detail"
    return c.issues


def load(source: str | Path | dict) -> dict:
    """A checked job from a file, JSON text or object."""
    if isinstance(source, dict):
        config = source
    else:
        text = str(source)
        config = json.loads(text if text.lstrip().startswith("{") else Path(text).read_text(encoding="utf-8"))
    config = canonical(config)
    if issues := check(config):
        raise ConfigError(issues)
    return config


def dump(config: dict) -> str:
    """Canonical text of a configuration."""
    return json.dumps(config, ensure_ascii=False, indent=2, sort_keys=True)
