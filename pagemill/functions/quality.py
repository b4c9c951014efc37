"""Content quality of a page as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, token_estimate, trim_all, word_count

#: Keyword lists of the quality rules.
PAYWALL = (
    "paywall", "subscribe", "subscription", "premium", "members only", "sign up to read", "login to continue", "paid content",
    "exclusive content", "premium-content", "subscriber-only", "paid-article", "paywall-content", "구독", "유료", "프리미엄", "회원전용",
)
ADS = (
    "ad-container", "ad-wrapper", "advertisement", "sponsored", "google-ad", "adsense", "ad-unit", "ad-slot", "banner-ad",
    "promoted-content", "sponsored-content", "native-ad",
)
LOGIN = ("login required", "sign in to", "log in to", "create an account", "register to", "members only", "로그인", "회원가입")
AGE = ("age-gate", "age-verification", "adult content", "18+", "성인인증")
STRUCTURED = ("application/ld+json", 'itemtype="http://schema.org', 'vocab="http://schema.org')
CITATIONS = ("[1]", "참고문헌", "References", "출처:")
CONTENT_TYPES = {
    "article": ("article", "news", "story", "post"),
    "blog": ("blog", "author", "posted by"),
    "documentation": ("docs", "documentation", "api", "reference", "guide"),
    "product": ("price", "buy", "cart", "add to cart", "product"),
    "forum": ("forum", "thread", "reply", "comment"),
}
AD_TAG = r"(?i)<(ins|iframe)[^>]*(adsense|doubleclick|googlesyndication)[^>]*>"


def any_of(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text holds any of some words; the text is made once, each word a plain search."""
    return let(text, lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in keywords]))


def _both(html: Column, text: Column) -> Column:
    return F.lower(F.concat(F.coalesce(html, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def has_paywall(html: Column, text: Column) -> Column:
    return any_of(_both(html, text), PAYWALL)


def requires_login(html: Column, text: Column) -> Column:
    return any_of(_both(html, text), LOGIN)


def age_restricted(html: Column) -> Column:
    return any_of(F.lower(F.coalesce(html, F.lit(""))), AGE)


def has_structured_data(html: Column) -> Column:
    return any_of(F.lower(F.coalesce(html, F.lit(""))), STRUCTURED)


def has_citations(text: Column) -> Column:
    return any_of(F.coalesce(text, F.lit("")), CITATIONS)


def content_type(title: Column, text: Column, url: Column) -> Column:
    every = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")), F.coalesce(url, F.lit(""))))
    chain = F
    for kind, keywords in CONTENT_TYPES.items():
        chain = chain.when(any_of(every, keywords), kind)
    return chain.otherwise("general")


def ad_density(html: Column) -> Column:
    low = F.lower(html)
    count = F.regexp_count(html, F.lit(AD_TAG))
    for keyword in ADS:
        count = count + (F.length(low) - F.length(F.replace(low, F.lit(keyword), F.lit("")))) / len(keyword)
    return F.coalesce(F.least(F.lit(1.0), count / 20.0), F.lit(0.0))


def content_ratio(html: Column, text: Column) -> Column:
    filled = (F.coalesce(trim_all(html), F.lit("")) != "") & (F.coalesce(trim_all(text), F.lit("")) != "")
    return F.when(filled, F.least(F.lit(1.0), F.length(text) / F.length(html) * 3)).otherwise(0.0)


def overall_score(paywall: Column, login: Column, ads: Column, ratio: Column, count: Column, headings: Column, metadata: Column) -> Column:
    score = (
        0.5
        - F.when(paywall, 0.3).otherwise(0.0)
        - F.when(login, 0.2).otherwise(0.0)
        - ads * 0.2
        + ratio * 0.2
        + F.when(count.between(100, 5000), 0.1).when(count > 5000, 0.05).otherwise(0.0)
        + F.when(headings >= 2, 0.05).otherwise(0.0)
        + F.when(metadata, 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def llm_suitability(ratio: Column, ads: Column, count: Column, tokens: Column) -> Column:
    score = (
        0.5
        + ratio * 0.3
        - ads * 0.2
        + F.when(count.between(500, 3000), 0.2).when(count < 500, -0.1).otherwise(0.0)
        + F.when(tokens <= 8000, 0.1).when(tokens > 32000, -0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "Excellent").when(score >= 0.6, "Good").when(score >= 0.4, "Fair").when(score >= 0.2, "Poor").otherwise("VeryPoor")
    )


def quality(html: Column, text: Column, title: Column, url: Column, headings: Column, metadata: Column) -> dict[str, Column]:
    """All quality columns of a page."""
    count, tokens = word_count(text), token_estimate(text)
    paywall, login, ads, ratio = has_paywall(html, text), requires_login(html, text), ad_density(html), content_ratio(html, text)
    overall = overall_score(paywall, login, ads, ratio, count, headings, metadata)
    return {
        "overall_score": overall,
        "grade": grade(overall),
        "content_type": content_type(title, text, url),
        "word_count": count,
        "reading_minutes": F.greatest(F.lit(1), F.ceil(count / 200.0)).cast("long"),
        "has_paywall": paywall,
        "requires_login": login,
        "has_age_restriction": age_restricted(html),
        "content_ratio": ratio,
        "ad_density": ads,
        "has_main_content": (F.coalesce(trim_all(text), F.lit("")) != "") & (count > 50),
        "has_structured_data": has_structured_data(html),
        "has_citations": has_citations(text),
        "is_secure": F.coalesce(F.startswith(F.lower(url), F.lit("https://")), F.lit(False)),
        "llm_suitability": llm_suitability(ratio, ads, count, tokens),
        "token_estimate": tokens,
        "noise_ratio": F.greatest(F.lit(0.0), 1 - ratio),
    }
