"""URL tokenizers as native column expressions.

Both stay inside whole-stage codegen: regexp_replace / split / filter only,
no Python.  A null url gives a null token array; callers that need the
"non-string url tokenises to nothing" rule wrap it in ``coalesce(…, array())``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
SCHEME_PREFIX = r"https?://"          # deleted anywhere, case-sensitive
WWW_PREFIX = r"www\."                 # deleted anywhere, case-sensitive
TOKEN_SPLIT = r"[./\-_=&?%]"          # T1 and the netloc/path part of T2
QUERY_SPLIT = r"[&?=]"                # query part of T2
MIN_TOKEN_CHARS = 2                   # keep tokens longer than one character
# Schemes after which Python's urlparse cuts ";params" off the last path
# segment (fixed list of the standard library).
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
                 "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_prefixes(url) -> Column:
    """Delete every ``http://``/``https://`` and ``www.`` (before lower-casing)."""
    return F.regexp_replace(F.regexp_replace(_col(url), SCHEME_PREFIX, ""), WWW_PREFIX, "")


def keep_long(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= MIN_TOKEN_CHARS)


def url_tokens(url) -> Column:
    """Strip prefixes, lower-case, split on ``[./\\-_=&?%]``, keep tokens of 2+ chars."""
    return keep_long(F.split(F.lower(strip_prefixes(url)), TOKEN_SPLIT))


def url_parts(url) -> dict[str, Column]:
    """Python-``urlparse`` compatible split of the prefix-stripped url.

    Returns scheme (lower-cased), netloc, path (params cut) and query columns.
    """
    s = strip_prefixes(url)
    s = F.regexp_replace(s, r"^[\x00-\x20]+", "")
    s = F.regexp_replace(s, r"[\t\r\n]", "")
    scheme_re = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
    scheme = F.lower(F.regexp_extract(s, scheme_re, 1))
    rest = F.regexp_replace(s, scheme_re, "")
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    rest = F.regexp_replace(rest, r"^//[^/?#]*", "")
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    path = F.regexp_replace(rest, r"(?s)\?.*$", "")
    path = F.when(scheme.isin(*PARAM_SCHEMES),
                  F.regexp_replace(path, r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1")).otherwise(path)
    return {"scheme": scheme, "netloc": netloc, "path": path, "query": query}


def url_tokens_structured(url) -> Column:
    """Netloc and path split as T1 (no lower-casing), query on ``[&?=]``."""
    p = url_parts(url)
    return keep_long(F.concat(F.split(p["netloc"], TOKEN_SPLIT),
                              F.split(p["path"], TOKEN_SPLIT),
                              F.split(p["query"], QUERY_SPLIT)))


def whitespace_tokens(text) -> Column:
    """Whitespace tokenizer used for free text (documents, prompts)."""
    return F.filter(F.split(_col(text), r"\s+"), lambda t: F.length(t) > 0)


TOKENIZERS = {
    "url": url_tokens,
    "structured": url_tokens_structured,
    "whitespace": whitespace_tokens,
}


def tokenizer(name_or_fn):
    return TOKENIZERS[name_or_fn] if isinstance(name_or_fn, str) else name_or_fn
