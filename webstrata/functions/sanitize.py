"""Noise removal from HTML as one regular expression, which the JVM runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements dropped with their content.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "canvas"]
#: Words that mark an <input> as volatile.
VOLATILE = [
    "csrf", "_token", "authenticity_token", "nonce", "__viewstate", "__eventvalidation",
    "session_id", "crumb", "ad-container", "cookie-banner", "optanon-alert-box", "consent-banner",
]
#: Attributes that make an <img> invisible.
HIDDEN = [
    'width="1"', "width='1'", "width=1 ", 'height="1"', "height='1'", "height=1 ", 'width="0"', "width='0'",
    'height="0"', "height='0'", "display:none", "display: none", "visibility:hidden", "visibility: hidden",
]


def noise_pattern() -> str:
    """Noise matches uncaptured; any other tag is captured whole, so nothing inside it can match. RE2 reads it too."""
    parts = [r"<!--[\s\S]*?(?:-->|\z)"]
    parts += [rf"<{t}[\s>/][\s\S]*?(?:</{t}[^>]*>|\z)" for t in DROPPED]
    parts += [rf"<input[^>]*?(?:{'|'.join(VOLATILE)})[^>]*>", rf"<img[^>]*?(?:{'|'.join(HIDDEN)})[^>]*>"]
    return "(?i)(?:" + "|".join(parts) + ")|(<[^>]*>)"


def sanitize_html(html: Column) -> Column:
    return F.regexp_replace(html, noise_pattern(), "$1")


def strip_banner_blocks(html: Column) -> Column:
    """Extra, never applied by default: flat <div>/<section> blocks whose tag names a cookie or consent banner."""
    return F.regexp_replace(html, r"(?i)<(div|section)[^>]*?(?:cookie-banner|consent-banner|ad-container)[^>]*>[\s\S]*?</\1>", "")
