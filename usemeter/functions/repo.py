"""Repository links: keys, parts, and the first link of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.text import BLANK_CLASS, blank_if_null, strip

_B = BLANK_CLASS


def _repo_regex(spec: UsageSpec) -> str:
    """Owner and name of a repo link as two groups."""
    return rf"(?iU){spec.host_regex}[/:]+([^/{_B}]+)/([^/{_B}#?]+)"


def _pair_regex(spec: UsageSpec) -> str:
    """``owner/name`` of a repo link as one group."""
    return rf"(?iU){spec.host_regex}[/:]+([^/{_B}]+/[^/{_B}#?]+)"


def repo_missing(url: Column, spec: UsageSpec) -> Column:
    """No link to the host.  Placeholders such as ``n/a`` never contain the host."""
    return ~F.contains(F.lower(blank_if_null(url)), F.lit(spec.host))


def is_repo_link(text: Column, spec: UsageSpec) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_repo_regex(spec))), F.lit(False))


def repo_owner(url: Column, spec: UsageSpec) -> Column:
    return F.regexp_extract(blank_if_null(url), _repo_regex(spec), 1)


def repo_name(url: Column, spec: UsageSpec) -> Column:
    """Repository name as written, without a trailing ``.git``; blank if there is none."""
    return F.regexp_replace(
        F.regexp_extract(blank_if_null(url), _repo_regex(spec), 2), r"\.git\z", ""
    )


def repo_key(url: Column, spec: UsageSpec) -> Column:
    """``owner/repo`` in lowercase; a cell without one is its own key."""
    url = blank_if_null(url)
    pair = F.regexp_extract(url, _pair_regex(spec), 1)
    return F.when(pair != "", F.regexp_replace(F.lower(pair), r"\.git\z", "")).otherwise(
        strip(F.lower(url))
    )


def first_link(cell: Column, spec: UsageSpec) -> Column:
    """First link in a cell, completed to an https address; null if there is none."""
    regex = rf"(?iU)https?://[^{_B}]+|(?:www\.|{spec.host_regex}/)[^{_B}]+"
    link = F.rtrim(F.regexp_extract(blank_if_null(cell), regex, 0), F.lit(").,;"))
    return F.when(F.startswith(F.lower(link), F.lit("http")), link).when(
        link != "", F.concat(F.lit("https://"), link)
    )
