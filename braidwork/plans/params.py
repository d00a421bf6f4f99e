"""Parameters of the service's routes (F14): defaults and bounds, applied before a plan is built."""

from __future__ import annotations


def number(value: object, default: int, most: int, least: int = 1) -> int:
    """A whole number between least and most; the default if it is missing or unreadable."""
    try:
        n = int(str(value))
    except ValueError:
        return default
    return max(least, min(most, n))


def graph_nodes(value: object = None) -> int:
    return number(value, 60, 200)


def stock_days(value: object = None) -> int:
    return number(value, 1, 30)


def meme_limit(value: object = None) -> int:
    return number(value, 10, 50)


def keyword(value: str, most: int = 30) -> str:
    """A keyword of 1 to `most` characters without spaces around; anything else is an error."""
    text = value.strip()
    if not 1 <= len(text) <= most:
        raise ValueError(f"a keyword has 1 to {most} characters")
    return text


def request_text(value: str) -> str:
    return keyword(value, 40)
