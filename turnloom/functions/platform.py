"""Chat platforms: address patterns, targets, rate-limit texts. Fixed values as tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address pattern of each platform, in the order they are tried.
SITES = (
    ("chatgpt", r"chat\.openai\.com|chatgpt\.com"),
    ("claude", r"claude\.ai"),
    ("gemini", r"gemini\.google\.com"),
    ("deepseek", r"chat\.deepseek\.com"),
    ("perplexity", r"perplexity\.ai"),
    ("copilot", r"copilot\.microsoft\.com"),
    ("grok", r"grok\.com|x\.com/i/grok"),
    ("kimi", r"kimi\.moonshot\.cn"),
    ("qwen", r"tongyi\.aliyun\.com|chat\.qwen\.ai"),
    ("poe", r"poe\.com"),
    ("huggingchat", r"huggingface\.co/chat"),
    ("notebooklm", r"notebooklm\.google\.com"),
    ("you", r"you\.com"),
    ("characterai", r"character\.ai"),
    ("pi", r"pi\.ai"),
    ("zai", r"z\.ai"),
    ("mistral", r"chat\.mistral\.ai"),
)
# Patterns for the best-score lookup, in platform order.
SCORED_SITES = (
    ("chatgpt", (r"chat\.openai\.com", r"chatgpt\.com")),
    ("claude", (r"claude\.ai",)),
    ("gemini", (r"gemini\.google\.com",)),
    ("deepseek", (r"chat\.deepseek\.com",)),
    ("perplexity", (r"perplexity\.ai",)),
    ("copilot", (r"copilot\.microsoft\.com",)),
    ("grok", (r"grok\.com", r"x\.com\/i\/grok")),
    ("kimi", (r"kimi\.moonshot\.cn",)),
    ("qwen", (r"tongyi\.aliyun\.com", r"chat\.qwen\.ai")),
    ("poe", (r"poe\.com",)),
    ("huggingchat", (r"huggingface\.co\/chat",)),
    ("notebooklm", (r"notebooklm\.google\.com",)),
    ("you", (r"you\.com",)),
    ("characterai", (r"character\.ai",)),
    ("pi", (r"pi\.ai",)),
    ("zai", (r"z\.ai",)),
    ("mistral", (r"chat\.mistral\.ai", r"mistral\.ai")),
)
# Platforms a conversation can be handed to.
TARGETS = ("claude", "chatgpt", "gemini", "deepseek", "perplexity", "copilot", "grok", "kimi", "qwen", "poe")

# Texts that announce a limit, per platform.
LIMIT_TEXTS = {
    "chatgpt": (
        r"You'?ve (reached|hit) the (current )?usage (cap|limit)",
        r"You'?ve (reached|hit) (the|your) (Free|GPT-4|GPT-4o|GPT-4\.\d) (plan )?(limit|cap|usage)",
        r"You'?ve (reached|exceeded) your (current )?(quota|usage)",
        r"You'?ve hit the rate limit",
        r"Too many requests",
        r"upgrade to (Plus|Pro|Team)",
        r"Get (Plus|Pro) to continue",
        r"Subscribe to Plus",
        r"rate limit reached",
        r"Your access to (GPT-4|GPT-4o) is (temporarily )?limited",
        r"Try again (after|in|in about)",
        r"You are currently on the Free plan",
    ),
    "claude": (
        r"rate limit reached",
        r"message limit reached",
        r"conversation limit reached",
        r"usage limit reached",
        r"you'?ve (reached|hit|exceeded)",
        r"you'?ve used all your messages",
        r"free plan limit",
        r"upgrade to (Pro|Max|Team)",
        r"try Pro",
        r"resets?\s+(at|in)\s+",
        r"wait\s+(\d+)\s*(minute|hour|second)",
        r"you'?re out of (free )?messages",
        r"limit\s+(\d+)\s+hours",
    ),
    "gemini": (
        r"Gemini\s+(isn'?t|is\s+not)\s+available\s+(right\s+now|at\s+the\s+moment)",
        r"please\s+try\s+again\s+(later|in\s+a\s+few\s+minutes)",
        r"usage\s+quota\s+exceeded",
        r"too\s+many\s+requests",
        r"you'?ve\s+reached\s+a\s+limit",
        r"rate\s+limit\s+exceeded",
        r"something\s+went\s+wrong",
        r"try\s+again\s+later",
        r"currently\s+unavailable",
        r"resource\s+has\s+been\s+exhausted",
        r"RESOURCE_EXHAUSTED",
    ),
    "deepseek": (
        r"每日.*(上限|限制|次数)",
        r"daily\s+limit\s+reached",
        r"you'?ve\s+reached\s+the\s+daily\s+(usage\s+)?limit",
        r"too\s+many\s+requests",
        r"请求过于频繁",
        r"服务器繁忙",
        r"server\s+is\s+busy",
        r"rate\s+limit",
        r"频率限制",
        r"稍后重试",
        r"try\s+again\s+(in|after|later)",
        r"usage\s+limit\s+reached",
        r"已达到.*上限",
    ),
    "perplexity": (
        r"you'?ve\s+reached\s+(the\s+)?daily\s+limit",
        r"you'?ve\s+used\s+all\s+your\s+Pro\s+searches",
        r"upgrade\s+to\s+Pro",
        r"(\d+)\s+searches?\s+remaining",
        r"too\s+many\s+requests",
        r"rate\s+limit",
        r"upgrade\s+for\s+unlimited",
        r"daily\s+quota\s+reached",
        r"free\s+plan\s+limit",
    ),
    "copilot": (
        r"you'?ve\s+reached\s+the\s+usage\s+limit",
        r"copilot\s+(free|chat)\s+limit\s+reached",
        r"(\d+)\/\d+\s+messages?\s+used",
        r"upgrade\s+(to\s+)?Copilot\s+Pro",
        r"you'?ve\s+used\s+all\s+(your\s+)?(free\s+)?(chat\s+)?messages",
        r"monthly\s+limit\s+reached",
    ),
    "grok": (
        r"you'?ve\s+reached\s+the\s+rate\s+limit",
        r"too\s+many\s+requests",
        r"please\s+try\s+again\s+later",
        r"you'?ve\s+hit\s+the\s+limit",
        r"wait\s+(\d+)\s*(minute|hour|second)",
        r"upgrade\s+(to|your)\s+(Premium|X\s+Premium)",
        r"grok.*limit",
        r"message\s+limit\s+reached",
        r"usage\s+limit",
    ),
    "kimi": (
        r"今日.*(上限|限制|次数)",
        r"已达到.*(上限|限制)",
        r"对话.*(用完|上限)",
        r"高峰期.*(稍后|再试)",
        r"请求过于频繁",
        r"服务繁忙",
        r"you'?ve\s+reached\s+the\s+daily\s+limit",
        r"too\s+many\s+requests",
        r"peak\s+hours",
        r"service\s+is\s+busy",
        r"次数.*(上限|用完|达到)",
        r"daily\s+usage\s+limit",
    ),
    "qwen": (
        r"免费额度.*(用完|耗尽|达到)",
        r"今日.*(上限|限制|额度)",
        r"已达到.*上限",
        r"请求过于频繁",
        r"服务繁忙",
        r"quota\s+exhausted",
        r"too\s+many\s+requests",
        r"usage\s+limit\s+reached",
        r"当前.*不可用",
        r"请稍后再试",
        r"稍后.*重试",
        r"daily\s+limit\s+reached",
    ),
    "poe": (
        r"you'?ve\s+reached\s+(your\s+)?daily\s+(message\s+)?limit",
        r"you'?ve\s+used\s+all\s+your\s+messages",
        r"subscribe\s+to\s+continue",
        r"daily\s+limit\s+reached",
        r"(\d+)\s+messages?\s+remaining",
        r"rate\s+limit\s+exceeded",
        r"too\s+many\s+requests",
        r"comput(e|ing)\s+points?\s+(exhausted|remaining)",
        r"out\s+of\s+messages",
        r"upgrade\s+(your\s+)?plan",
    ),
}
# The shared list of the platforms without one of their own.
GENERIC_LIMIT_TEXTS = (r"rate limit", r"too many", r"try again", r"quota", r"upgrade")
GENERIC_PLATFORMS = ("huggingchat", "notebooklm", "you", "characterai", "pi", "zai", "mistral")
# Words in the body of a refusal that make it a limit.
REFUSAL_WORDS = ("rate_limit", "rate limit", "too many requests", "quota")


def platform_of(url: Column, strict: bool = False) -> Column:
    """First platform whose pattern is found. `strict` accepts the pattern only as the host."""
    out = F.lit("unknown")
    for name, pattern in reversed(SITES):
        shown = rf"^https?://(?:[A-Za-z0-9-]+\.)*(?:{pattern})(?:[/?#:]|$)" if strict else pattern
        out = F.when(url.rlike(shown), F.lit(name)).otherwise(out)
    return F.when(url.isNull() | (url == ""), F.lit("unknown")).otherwise(out)


def pattern_score(pattern: str) -> int:
    return 10 + 2 * len(pattern) + (5 if r"\/" in pattern else 0) + (3 if pattern.startswith("^") else 0)


def platform_by_score(url: Column) -> Column:
    """Platform with the highest pattern score; the earlier one on ties."""
    scored = [
        F.struct(
            F.greatest(*[F.when(url.rlike(p), F.lit(pattern_score(p))).otherwise(F.lit(0)) for p in patterns], F.lit(0)).alias("score"),
            F.lit(-i).alias("order"),
            F.lit(name).alias("name"),
        )
        for i, (name, patterns) in enumerate(SCORED_SITES)
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit("unknown"))


def other_targets(platform: Column) -> Column:
    return F.array_except(F.array(*[F.lit(t) for t in TARGETS]), F.array(platform))


def limit_message(platform: Column, text: Column) -> Column:
    """What a text says about a limit on its platform: the hit of the first pattern in list order, or null."""

    def first_hit(patterns):
        hits = [F.nullif(F.regexp_extract(text, "(?i)(" + p + ")", 1), F.lit("")) for p in patterns]
        whole = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        return F.when(text.rlike(whole), F.coalesce(*hits))

    out = F.when(platform.isin(*GENERIC_PLATFORMS), first_hit(GENERIC_LIMIT_TEXTS))
    for name, patterns in LIMIT_TEXTS.items():
        out = out.when(platform == name, first_hit(patterns))
    return out


def is_limit_response(status: Column, url: Column, body: Column, api_pattern: str) -> Column:
    """A 429 on an interface address, or a refusal whose body names a limit."""
    low = F.lower(F.coalesce(body, F.lit("")))
    named = F.lit(False)
    for w in REFUSAL_WORDS:
        named = named | F.contains(low, F.lit(w))
    return ((status == 429) & url.rlike(api_pattern)) | (status.isin(429, 403) & named)


def reset_seconds(header: Column) -> Column:
    """Duration headers such as `6m0s`, `1h2m`, `20ms` in seconds; null for anything else."""
    whole = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:\.\d+)?)s)?(?:(\d+)ms)?$"

    def part(i):
        return F.coalesce(F.regexp_extract(header, whole, i).try_cast("double"), F.lit(0.0))

    return F.when((F.length(header) > 0) & header.rlike(whole), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)


def limit_headers(headers: Column, now: Column) -> dict[str, Column]:
    """Remaining requests and tokens and the reset time, from a header map of either family."""

    def number(*names):
        return F.coalesce(*[F.regexp_extract(F.try_element_at(headers, F.lit(n)), r"^\s*(-?\d+)", 1).try_cast("bigint") for n in names])

    duration = reset_seconds(F.try_element_at(headers, F.lit("x-ratelimit-reset-requests")))
    absolute = F.coalesce(
        F.try_element_at(headers, F.lit("anthropic-ratelimit-requests-reset")), F.try_element_at(headers, F.lit("x-ratelimit-reset-requests"))
    ).try_cast("timestamp")
    relative = F.timestamp_micros((F.unix_micros(now) + duration * 1_000_000).cast("bigint"))
    return {
        "requests_remaining": number("x-ratelimit-remaining-requests", "anthropic-ratelimit-requests-remaining"),
        "tokens_remaining": number("x-ratelimit-remaining-tokens", "anthropic-ratelimit-tokens-remaining"),
        "reset_at": F.coalesce(relative, absolute),
    }
