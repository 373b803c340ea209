"""Verdicts over all attempts of fetching a site.

Every rule asks for all, any, most or none of a group of attempts, so one aggregate by site counts what the rules need, partially before its
shuffle, and the verdict is a chain of expressions over these counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import urls

#: Marks of an error of certificates, names or connections.
CONNECTION_ERRORS = (
    "CERTIFICATE_VERIFY_FAILED", "Hostname mismatch", "SSL: ", "ERR_CERT_", "ERR_NAME_NOT_RESOLVED", "[Errno -2]", "[Errno -3]", "[Errno -5]", "No address associated with hostname", "Name or service not known",
    "nodename nor servname provided", "Temporary failure in name resolution", "ConnectError", "Connection refused", "connection refused", "ConnectTimeout", "timed out", "WinError 10061", "WinError 10060",
    "All connection attempts failed", "RemoteProtocolError", "Server disconnected", "RemoteDisconnected",
)
#: What the verdicts and the recommended strategies are called.
STATIC, CAPTURED, RENDERED, PENDING = "정적 HTTP로 충분", "캡처 헤더 주입 시 정적 가능", "JS 실행 필요 (Cloudflare 등)", "분류 보류"
PRIMARY, TARGET = ("static", "headless"), ("static", "headless", "captured", "login_headers")


def attempt_sums(attempts: DataFrame) -> DataFrame:
    """A row for each site: how many attempts of each group there are, and how many of each class.

    attempts: site, site_url, way (baseline, static, headless, captured, login_headers, external, paid), name, class, status, error,
    notable (array), final_url."""
    way, kind = F.col("way"), F.coalesce("class", F.lit(""))
    noted = lambda mark: F.exists(F.coalesce("notable", F.array().cast("array<string>")), lambda n: F.coalesce(n.contains(mark), F.lit(False)))
    broken = F.coalesce(F.col("error").rlike("|".join(map(re.escape, CONNECTION_ERRORS))), F.lit(False))
    base, static, primary, target = way == "baseline", way == "static", way.isin(*PRIMARY), way.isin(*TARGET)
    moved = F.coalesce(urls.registrable(F.col("final_url")) != urls.registrable(F.col("site_url")), F.lit(False))
    # the weakest headers that worked; ways without a number come last
    rank = F.coalesce(F.nullif(F.regexp_extract("name", r"\.H([1-4])$", 1), F.lit("")).cast("int"), F.lit(99))
    first = lambda c: F.min_by("name", F.when(c & (kind == "OK"), F.struct(rank, F.col("name"))))
    return attempts.groupBy("site").agg(
        F.count_if(base).alias("n_base"),
        *(F.count_if(base & (kind == k)).alias(f"base_{n}") for n, k in (("ok", "OK"), ("bot", "BLOCKED_BOT"), ("unknown", "UNKNOWN_ERROR"))),
        F.count_if(base & broken).alias("base_broken"),
        F.count_if(static).alias("n_static"),
        F.count_if(static & (kind == "OK")).alias("static_ok"),
        F.count_if(static & (F.col("status") == 406)).alias("static_406"),
        F.count_if(static & noted("Cloudflare")).alias("static_guarded"),
        *(F.count_if((way == w) & (kind == "OK")).alias(f"{w}_ok") for w in ("captured", "headless", "external", "paid")),
        F.count_if(primary).alias("n_primary"),
        F.count_if(primary & (kind == "OK")).alias("primary_ok"),
        F.count_if(primary & (kind == "OK") & moved).alias("primary_moved"),
        F.count_if(primary & (kind == "NOT_FOUND")).alias("primary_gone"),
        F.count_if(primary & (kind == "BLOCKED_BOT") & noted("suspiciously empty body")).alias("primary_empty"),
        F.count_if(target).alias("n_target"),
        *(F.count_if(target & (kind == k)).alias(f"target_{n}") for n, k in (("ok", "OK"), ("login", "LOGIN_REQUIRED"), ("gone", "NOT_FOUND"), ("bot", "BLOCKED_BOT"), ("unknown", "UNKNOWN_ERROR"))),
        F.count_if(target & broken).alias("target_broken"),
        F.count_if(target & (kind == "LOGIN_REQUIRED") & noted("redirected to login")).alias("login_redirects"),
        first(static).alias("easiest"),
        first(way == "external").alias("external_name"),
        first(way == "paid").alias("paid_name"),
    )


def verdicts(attempts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """site, verdict (its tags joined by ' / '), tags, strategy and headers (the cheapest way that worked) of every site.

    rendered (site, insufficient): sites whose static body is an empty shell beside the rendered one; their static and captured
    successes don't count. A site without attempts of the baseline counts as blocked there."""
    s = attempt_sums(attempts)
    s = s.join(rendered.groupBy("site").agg(F.bool_or("insufficient").alias("shell")), "site", "left") if rendered is not None else s.withColumn("shell", F.lit(False))
    c = F.col
    # a shell only shows beside a rendering that worked
    shell = F.coalesce("shell", F.lit(False)) & (c("headless_ok") > 0)
    s = s.withColumns({"static_fine": (c("static_ok") > 0) & ~shell, "captured_fine": (c("captured_ok") > 0) & ~shell})
    every = lambda n, of: (c(of) > 0) & (c(n) == c(of))
    base_bot = every("base_bot", "n_base")
    base_dead = every("base_unknown", "n_base") & (c("base_broken") > 0)
    base_fine = (c("base_ok") > 0) | base_bot
    login = (c("target_login") > 0) & (c("target_ok") == 0)
    tag = lambda cond, name: F.when(cond, F.lit(name))
    moved = base_fine & every("primary_moved", "primary_ok")
    at_base = F.when(base_bot, "CLOUDFLARE_PROTECTED_SITE").when(base_dead, "CERT_OR_DNS_BROKEN").when(~base_fine, "BASELINE_BLOCKED")
    way = F.when(moved, "CROSS_HOST_REDIRECT").when(c("static_fine") & (c("static_guarded") == 0), STATIC).when(c("captured_fine"), CAPTURED).when(c("headless_ok") > 0, RENDERED)
    own = F.when(login, F.array(F.when(c("login_redirects") > 0, "LOGIN_REDIRECT").otherwise("LOGIN_MARKER"))).otherwise(F.array_compact(F.array(at_base, tag(every("static_406", "n_static"), "WAF_406_BLOCK"), way)))
    s = s.withColumn("tags", own)
    blocked = F.arrays_overlap("tags", F.array(*map(F.lit, ("CLOUDFLARE_PROTECTED_SITE", "BASELINE_BLOCKED", "WAF_406_BLOCK"))))
    s = s.withColumn("tags", F.when(blocked & every("primary_gone", "n_primary"), F.array_append("tags", F.lit("TARGET_NOT_FOUND"))).otherwise(c("tags")))
    most_gone = (c("primary_gone") >= 2) & (c("primary_ok") == 0) & (c("primary_gone") + c("primary_empty") == c("n_primary"))
    last = (
        F.when(every("target_gone", "n_target") | every("primary_gone", "n_primary") | most_gone, "TARGET_NOT_FOUND")
        .when(every("target_bot", "n_target"), "ENTRY_BLOCKED")
        .when(every("target_unknown", "n_target") & (c("target_broken") > 0), "STATIC_PATH_DEAD")
    )
    s = s.withColumn("tags", F.when(base_fine & (F.size("tags") == 0) & last.isNotNull(), F.array(last)).otherwise(c("tags")))
    strategy = (
        F.when(c("static_fine"), F.concat(F.lit("httpx ("), "easiest", F.lit(")")))
        .when(c("captured_fine"), "httpx + 캡처된 메인 문서 헤더 (S1.Hcap)")
        .when(c("headless_ok") > 0, "Playwright headless + stealth (S4)")
        .when(c("external_ok") > 0, F.concat(F.lit("외부 서비스 ("), "external_name", F.lit(")")))
        .when(c("paid_ok") > 0, F.concat(F.lit("유료 API ("), "paid_name", F.lit(")")))
        .otherwise("통과한 전략 없음 — 추가 검토 필요")
    )
    headers = F.when(c("static_fine"), c("easiest")).when(c("captured_fine"), "S1.Hcap").when(c("headless_ok") > 0, "S4 (브라우저)").otherwise("n/a")
    return s.select("site", F.when(F.size("tags") > 0, F.array_join("tags", " / ")).otherwise(PENDING).alias("verdict"), "tags", strategy.alias("strategy"), headers.alias("headers"))


# --- what is wrong with a site that is watched ----------------------------------------------------------------------------------

SEVERITIES = ("error", "warn", "info")
#: Polls in a row without a body, hours without a poll, and days without a delivery that are too many.
DRIFT, STALE_HOURS, SILENT_DAYS = 3, 24, 7


def query_keys(url: Column) -> Column:
    """The names of a URL's parameters that have a value."""
    pairs = F.filter(F.split(urls.query(url), "&"), lambda p: p.rlike("^[^=]+=."))
    return F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1))))


def lost_queries(sites: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """slug, severity, tag, detail: of the addresses that a site was registered by (those of its subscriptions in their order, then its job's)
    the first whose parameters its configuration has none of; a warning if it has no parameters at all."""
    known = sites.select("slug", F.coalesce("config_keys", F.array().cast("array<string>")).alias("keys"))
    own = subscriptions.groupBy("slug", "url").agg(F.min("id").alias("pos")).select("slug", "url", "pos")
    every = own.unionByName(sites.select("slug", F.col("job_url").alias("url"), F.lit((1 << 63) - 1).alias("pos"))).where("url <> ''")
    odd = every.join(known, "slug").withColumn("asked", query_keys(F.col("url"))).where((F.size("asked") > 0) & ~F.arrays_overlap("asked", "keys"))
    first = odd.groupBy("slug").agg(F.min_by(F.struct("url", F.size("keys").alias("n")), "pos").alias("x"))
    none = F.col("x.n") == 0
    return first.select("slug", F.when(none, "warn").otherwise("info").alias("severity"), F.when(none, "query_kwargs_mismatch").otherwise("query_kwargs_keys_disjoint").alias("tag"), F.col("x.url").alias("detail"))


def never_delivered(subscriptions: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    """A warning for every subscription that is old enough and to whose target nothing of its site was sent; what was filtered doesn't count."""
    old = subscriptions.where(F.col("created_at") <= now - F.expr(f"interval {SILENT_DAYS} days"))
    sent = deliveries.where("kind = 'sent'").select("slug", "target_id").distinct()
    return old.join(sent, ["slug", "target_id"], "left_anti").select("slug", F.lit("warn").alias("severity"), F.lit("never_delivered").alias("tag"), F.col("target_id").cast("string").alias("detail"))


def sampled_findings(sampled: DataFrame, samples: DataFrame) -> DataFrame:
    """Findings of trial fetches: sampled (slug) says for which sites there was one, samples (slug, post_id, body_chars) what it gave:
    nothing, several posts of one id, or only empty bodies."""
    sums = samples.groupBy("slug").agg(F.count("*").alias("n"), F.min("post_id").alias("lo"), F.max("post_id").alias("hi"), F.count("body_chars").alias("bodies"), F.coalesce(F.max("body_chars"), F.lit(0)).alias("longest"))
    s = sampled.select("slug").distinct().join(sums, "slug", "left")
    rules = (
        ("error", "fetch_sim_empty", F.col("n").isNull(), F.lit(None).cast("string")),
        ("error", "fetch_sim_same_id", (F.col("n") > 1) & F.col("lo").eqNullSafe(F.col("hi")), F.col("lo").cast("string")),
        ("warn", "article_body_empty", (F.col("bodies") > 0) & (F.col("longest") == 0), F.col("bodies").cast("string")),
    )
    return _found(s, rules)


def _found(rows: DataFrame, rules: tuple) -> DataFrame:
    """slug, severity, tag, detail of the rules (severity, tag, condition, detail) that hold; rows are read once."""
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(t).alias("tag"), d.alias("detail"))) for s, t, c, d in rules)))
    return rows.select("slug", F.explode(each).alias("f")).select("slug", "f.*")


def site_findings(sites: DataFrame, subscriptions: DataFrame, deliveries: DataFrame, sampled: DataFrame, samples: DataFrame, now: Column) -> DataFrame:
    """slug, place, severity, tag, detail of everything that is wrong with a site, within a site the worst first.

    sites: slug, failed, has_config, config_keys (the parameters that its configuration passes on), job_url, breakage, body_empty_streak,
    last_poll_at, n_baseline; subscriptions: id, slug, url, target_id, created_at. What is null is unknown and no finding."""
    text = lambda c: F.col(c).cast("string")
    rules = (
        ("error", "auto_register_failed", F.col("failed"), F.lit(None).cast("string")),
        ("error", "config_missing", ~F.col("has_config"), F.lit(None).cast("string")),
        ("error", "breakage_signal", F.col("breakage") > 0, text("breakage")),
        ("error", "body_empty_drift", F.col("body_empty_streak") >= DRIFT, text("body_empty_streak")),
        ("warn", "stale_poll", now - F.expr(f"interval {STALE_HOURS} hours") > F.col("last_poll_at"), F.date_format("last_poll_at", "yyyy-MM-dd HH:mm:ss")),
        ("info", "empty_baseline", F.col("n_baseline") == 0, F.lit(None).cast("string")),
    )
    every = _found(sites, rules).unionByName(lost_queries(sites, subscriptions)).unionByName(never_delivered(subscriptions, deliveries, now)).unionByName(sampled_findings(sampled, samples))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("slug").orderBy(rank, "tag", "detail"))).select("slug", "place", "severity", "tag", "detail")
