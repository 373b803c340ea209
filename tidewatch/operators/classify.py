"""Ordered rules as one CASE expression each; the first rule that fits decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of responses, in the languages they come in.
LOGIN_PATH = r"(?i)(/login|/signin|/sign-in|/auth/login|/users?/login)"
LOGIN_STRONG = ("please log in to view", "you must be logged in to view", "this page requires login", "로그인 후 이용 가능", "로그인 후 확인", "로그인이 필요한 서비스", "로그인 후 이용해 주세요")
LOGIN_WEAK = ("please log in", "please sign in", "sign in to view", "you must be logged in", "로그인이 필요", "로그인 후 이용")
LOGIN_FORM = r"""(?i)<input[^>]+type=["']password["']|<form[^>]+action=["'][^"']*(login|signin)"""
BOT_STRONG = ("Just a moment", "cf-chl-opt", "challenge-platform", "비정상적인 접근", "차단되었습니다", "Attention Required", "Cloudflare Ray ID", "Please complete the security check")
BOT_WEAK = ("Too Many Requests", "Rate limit exceeded", "Access denied", "blocked")
CHALLENGE = ("cf-chl-opt", "cdn-cgi/challenge-platform", "__cf_chl", "anubis_challenge", "anubis/api/make_challenge", ".within.website/x/xess", "making sure you're not a bot")
GEO = ("Unavailable For Legal Reasons", "이 채널은 한국", "지역에서 이용", "available in your country", "not available in your region")
PARKED = r"(?i)<title[^>]*>\s*Access\s+Denied\s*</title>"
LANDER = r"""(?i)window\.location\.href\s*=\s*["']\s*/?(lander|parked|expired)["']"""


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m.lower())) for m in marks))


def response(status: Column, body: Column, final_url: Column, headers: Column, redirected_to_login: Column, error: Column, baseline_blocked: Column, method_incompatible: Column, is_robots: Column) -> Column:
    """Class of an HTTP response; headers is a map with lower-case names."""
    text = F.coalesce(body, F.lit(""))
    visible = F.trim(F.regexp_replace(text, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", ""))
    low, n = F.lower(visible), F.length(visible)
    raw = F.lower(F.substring(text, 1, 50_000))
    mitigated = F.map_contains_key(headers, "cf-mitigated") | F.map_contains_key(headers, "retry-after")
    kind, server = F.lower(F.coalesce(headers["content-type"], F.lit(""))), F.lower(F.coalesce(headers["server"], F.lit("")))
    count_404 = F.size(F.regexp_extract_all(F.substring(low, 1, 8000), F.lit(r"\b(404)\b"), F.lit(1)))
    soft_404 = (status == 403) & ~mitigated & (
        (kind.contains("xml") & server.contains("amazons3") & text.rlike(r"(?i)<Code>\s*AccessDenied\s*</Code>"))
        | ((n < 80) & (F.length(F.trim(text)) < 200))
        | ((kind.contains("html") | raw.contains("<html")) & ((count_404 >= 2) | ((count_404 >= 1) & low.contains("not found"))))
    )
    bad = status.isin(403, 429, 503)
    return (
        F.when(F.coalesce(method_incompatible, F.lit(False)), "METHOD_INCOMPATIBLE")
        .when(error.isNotNull() & status.isNull(), "UNKNOWN_ERROR")
        .when(F.coalesce(redirected_to_login, F.lit(False)) | F.coalesce(final_url.rlike(LOGIN_PATH), F.lit(False)), "LOGIN_REQUIRED")
        .when(_has(low, LOGIN_STRONG), "LOGIN_REQUIRED")
        .when(_has(low, LOGIN_WEAK) & (n < 4000), "LOGIN_REQUIRED")
        .when(text.rlike(LOGIN_FORM) & (n < 6000), "LOGIN_REQUIRED")
        .when(status == 404, "NOT_FOUND")
        .when(text.rlike(PARKED) & (n <= 500), "NOT_FOUND")
        .when((status == 200) & (F.length(text) < 400) & text.rlike(LANDER), "NOT_FOUND")
        .when((status == 451) | _has(low, GEO), "BLOCKED_GEO")
        .when(_has(raw, CHALLENGE), F.when(F.coalesce(baseline_blocked, F.lit(False)) & (status >= 400), "BLOCKED_IP").otherwise("BLOCKED_BOT"))
        .when(soft_404, "NOT_FOUND")
        .when(bad | mitigated | _has(F.substring(low, 1, 8000), BOT_STRONG) | (_has(low, BOT_WEAK) & ((status >= 400) | (n < 500))), F.when(F.coalesce(baseline_blocked, F.lit(False)) & (status >= 400), "BLOCKED_IP").otherwise("BLOCKED_BOT"))
        .when(status.between(200, 399), F.when(F.coalesce(is_robots, F.lit(False)), "OK").when(F.length(text) < 200, "BLOCKED_BOT").otherwise("OK"))
        .when((status >= 400) & F.coalesce(baseline_blocked, F.lit(False)), "BLOCKED_IP")
        .otherwise("UNKNOWN_ERROR")
    )


# What a failed job's tail holds, by kind and in order.
DEAD = {
    "target_not_found": ("TARGET_NOT_FOUND", "URL 이 잘못됐거나 글이 삭제된"),
    "cert_or_dns_broken": ("CERT_OR_DNS_BROKEN", "SSL 인증서/DNS 가 깨짐"),
    "soft_404": ("SOFT_404", "not-found shell"),
    "agent_self_veto_non_existent": ("agent_self_veto:non_existent", "agent self-veto(non_existent)"),
}
POLICY = {
    "login_required": ("LOGIN_REQUIRED",),
    "agent_self_veto_login": ("agent_self_veto:login_required", "agent self-veto(login_required)"),
    "blocked_bot": ("BLOCKED_BOT",),
    "blocked_ip": ("BLOCKED_IP",),
    "blocked_geo": ("BLOCKED_GEO",),
}
CAPABILITY = {
    "cloudflare": ("CLOUDFLARE",),
    "baseline_blocked": ("BASELINE_BLOCKED",),
    "probe_memory_guard": ("probe_memory_guard", "probe memory guard"),
    "http_4xx_blocked": ("http_4xx_blocked", "403 Forbidden", "451 Unavailable", "429 Too Many Requests"),
    "entry_blocked": ("능력 부족", "접근 실패", "BLOCKED"),
}
GATE = {
    "nav_only": ("nav-only same-host",),
    "meta_diverging": ("meta 선언 + 발산",),
    "multi_host_hub": ("multi-host hub root",),
    "root_marketing_homepage": ("root 도메인 마케팅 랜딩",),
    "board_shape": ("게시판 형식 아님",),
    "agent_self_veto_non_board": ("agent_self_veto:non_board", "agent self-veto(non_board)"),
    "post_preflight_no_first": ("post-preflight NO_FIRST", "post_preflight_no_first"),
    "classifier_reject": ("accept_path", "분류기"),
}
GENERATION = {
    "llm_parse": ("LLM 응답 JSON 파싱 실패", "JSON 으로 파싱 실패", "Expecting ',' delimiter", "Expecting value", "Expecting property name"),
    "llm_api": ("RESOURCE_EXHAUSTED", "UNAVAILABLE", "LLM 호출 실패", "LLM 호출", "gemini 호출"),
}
KNOWN_CHECKS = ("posts_nonempty", "article_body_len", "published_at_iso", "post_id_stable_shape", "title_nonempty")
BUG_CODES = {-1: "chromium_lock_timeout", -2: "subprocess_timeout", -3: "subprocess_exception", -4: "register_audit_violation", -5: "attempts_limit", 0: "registered_but_no_state"}


def _first_token(tail: Column, table: dict[str, tuple[str, ...]]) -> Column:
    hit = lambda marks: reduce(lambda a, b: a | b, (F.contains(tail, F.lit(m)) for m in marks))
    return F.coalesce(*(F.when(hit(marks), F.lit(name)) for name, marks in table.items()))


def failure(status: Column, rc: Column, tail: Column) -> tuple[Column, Column]:
    """(kind, subkind) of a job. A URL that is dead is told before a policy that rejects; of several failed checks the last counts, and
    a check or recogniser without an entry here passes through by its own name."""
    text = F.coalesce(tail, F.lit(""))
    dead = (rc == 4) | ((rc == 2) & _first_token(text, {k: DEAD[k] for k in ("target_not_found", "cert_or_dns_broken", "soft_404")}).isNotNull())
    bug = rc.isin(-1, -2, -3, -4, -5, -99) | ((status == "failed") & (rc == 0))
    kind = (
        F.when(status.isin("pending", "running"), status)
        .when((rc == 0) & (status != "failed"), "done")
        .when(rc == 1, "gen_fail")
        .when(dead, "url_dead")
        .when(rc == 2, "policy_reject")
        .when(rc == 5, "capability_blocked")
        .when(rc == 3, "gate_reject")
        .when(bug, "bug")
        .otherwise("unknown")
    )
    last_check = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\[FAIL\]\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lit(-1))
    # of attempts that say what failed, the last one counts
    errors = F.regexp_extract_all(text, F.lit(r'"error"\s*:\s*"((?:\\.|[^"\\])*)"'), F.lit(1))
    timeout = F.coalesce(F.try_element_at(errors, F.lit(-1)), text).rlike(r"validate_internal_timeout_[0-9]+s")
    known = F.when(last_check.isin(*KNOWN_CHECKS), last_check)
    generation = F.coalesce(known, F.when(timeout, F.lit("validate_timeout")), last_check, _first_token(text, GENERATION))
    recogniser = F.when(text.rlike(r"recognize_reject\s+\([^)]+\)"), F.concat(F.lit("recognizer:"), F.trim(F.regexp_extract(text, r"recognize_reject\s+\(([^)]+)\)", 1))))
    code = F.coalesce(*(F.when(rc == k, F.lit(v)) for k, v in BUG_CODES.items()))
    subkind = (
        F.when(kind == "gen_fail", generation)
        .when(kind == "url_dead", _first_token(text, DEAD))
        .when(kind == "policy_reject", _first_token(text, POLICY))
        .when(kind == "capability_blocked", _first_token(text, CAPABILITY))
        .when(kind == "gate_reject", F.coalesce(recogniser, _first_token(text, GATE)))
        .when(kind == "bug", code)
    )
    return kind, subkind


def display_group(rc: Column, broken: Column) -> Column:
    """What a visitor is shown of a site."""
    return F.when(broken, "broken").when(rc.isNull(), "waiting").when(rc == 0, "ok").when(rc.isin(2, 3), "rejected").when(rc == 4, "gone").when(rc == 5, "blocked").otherwise("failed")


def site_kind(feed: Column, link_feed: Column, audio: Column, rows: Column, semantic: Column, script: Column) -> tuple[Column, Column]:
    """(kind, confidence) of a site from its feeds, the number of rows of its list and its need of scripts."""
    kind = (
        F.when(feed & audio, "podcast")
        .when(feed & (rows >= 5) & (semantic | (rows >= 10)), "hybrid")
        .when(feed & (rows < 3), "rss")
        .when(~feed & link_feed & audio, "podcast")
        .when(~feed & link_feed & (rows < 3), "rss")
        .when(~feed & link_feed & (rows >= 5), "hybrid")
        .when(~feed & ~link_feed & ~script & (rows >= 5), "static_html")
        .when(~feed & ~link_feed & script & (rows < 3), "spa_rendered")
        .otherwise("unknown")
    )
    weak = (~feed & link_feed) | ((kind == "static_html") & (rows < 10)) | ((kind == "hybrid") & ~semantic)
    confidence = F.when(kind == "unknown", "low").when(weak, "med").otherwise("high")
    return kind, confidence


def arbitration(gate_rejects: Column, label: Column, confidence: Column) -> Column:
    """Exit code of a page's gates with a classifier's label: an index may be rescued, other kinds may be refused."""
    return (
        F.when(gate_rejects & (label == "index") & (confidence >= 0.5), 0)
        .when(label.isin("content", "catalog") & (confidence >= 0.7), 3)
        .when((label == "not_found") & (confidence >= 0.7), 4)
        .when((label == "login") & (confidence >= 0.7), 2)
        .when(gate_rejects, 3)
        .otherwise(0)
    )


def strategy(attempts: DataFrame) -> DataFrame:
    """site and the cheapest way of fetching it that worked: static, captured, headless, external, paid, or none."""
    ladder = ("static", "captured", "headless", "external", "paid")
    rank = F.coalesce(*(F.when(F.col("way") == w, F.lit(k)) for k, w in enumerate(ladder)))
    best = attempts.where("class = 'OK'").groupBy("site").agg(F.min(rank).alias("k"))
    names = F.array(*map(F.lit, ladder))
    rows = attempts.select("site").distinct().join(best, "site", "left")
    return rows.select("site", F.coalesce(F.try_element_at(names, F.col("k") + 1), F.lit("none")).alias("strategy"))


def site_findings(sites: DataFrame, stale_hours: int = 24) -> DataFrame:
    """site, severity, tag of everything wrong with a site, the worst first. Each rule is an entry of one array, so sites are read once."""
    rules = [
        (0, "config_missing", ~F.col("has_config")),
        (0, "broken", F.col("streak") >= 3),
        (1, "breakage", F.col("streak").between(1, 2)),
        (1, "body_drift", F.col("empty_streak") >= 3),
        (2, "stale", F.col("hours_since_poll") > stale_hours),
        (2, "never_delivered", (F.col("n_sent") == 0) & (F.col("age_days") >= 7)),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(t).alias("tag"))) for s, t, c in rules)))
    return sites.select("site", F.explode(found).alias("f")).select("site", "f.severity", "f.tag").orderBy("severity", "tag", "site")
