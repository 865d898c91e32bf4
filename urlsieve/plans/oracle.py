"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement rebuilds its derived views as CTEs over the driver's
pre-registered tables and writes the operator the plain way (unbucketed
windows, joins), independently of the Spark code.  Column names and integer
widths match the Spark results.
"""

from __future__ import annotations

NL = "chr(10)"

# --- derived views ---------------------------------------------------------------
URLS = ("urls AS (SELECT page_id AS row_id, url, "
        "CASE WHEN url LIKE '%://blog.%' THEN 1 ELSE 0 END AS label FROM pages)")
RAW_URLS = ("raw_urls AS (SELECT page_id, url, CASE WHEN url LIKE '%://blog.%' "
            "THEN 'phishing' ELSE 'legitimate' END AS status FROM pages)")
TEXTS = ("texts AS (SELECT d.doc_id AS row_id, d.text, l.toxic AS label "
         "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
SCORED = ("scored AS (SELECT o_orderkey AS row_id, 'http://c' || CAST(o_custkey % 500 AS VARCHAR) "
          "|| '.example.com/o/' || CAST(o_orderkey % 97 AS VARCHAR) AS url, "
          "CAST(o_orderstatus = 'F' AS INTEGER) AS true_label, "
          "o_totalprice / 500000.0 AS layer1_confidence FROM orders)")
HISTORY = ("history AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id "
           "ORDER BY ts, event_id) AS INTEGER) AS epoch, ts, "
           "CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS train_loss, "
           "value AS val_loss, 1.0 / (1.0 + value) AS accuracy FROM events)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- expressions -------------------------------------------------------------------

def strip_prefixes(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, 'https?://', '', 'g'), 'www\\.', '', 'g')"


def t1(c: str) -> str:
    return (f"list_filter(string_split_regex(lower({strip_prefixes(c)}), '[./\\-_=&?%]'), "
            f"lambda x: length(x) >= 2)")


def t2(c: str) -> str:
    s = strip_prefixes(c)
    s = f"regexp_replace(regexp_replace({s}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    scheme_re = "'^([A-Za-z][A-Za-z0-9+.\\-]*):'"
    return f"""(SELECT list_filter(list_concat(
        string_split_regex(netloc, '[./\\-_=&?%]'),
        string_split_regex(CASE WHEN scheme IN ('', 'ftp', 'hdl', 'prospero', 'http', 'imap', 'https',
              'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip', 'sips', 'mms', 'sftp', 'tel')
            THEN regexp_replace(path, '(?s)^((?:.*/)?[^/;]*);[^/]*$', '\\1') ELSE path END, '[./\\-_=&?%]'),
        string_split_regex(query, '[&?=]')), lambda x: length(x) >= 2)
      FROM (SELECT scheme, netloc, regexp_replace(r3, '(?s)\\?.*$', '') AS path,
                   regexp_extract(r3, '(?s)^[^?]*\\?(.*)$', 1) AS query
            FROM (SELECT scheme, netloc, regexp_replace(r2, '(?s)#.*$', '') AS r3
                  FROM (SELECT scheme, regexp_extract(r1, '^//([^/?#]*)', 1) AS netloc,
                               regexp_replace(r1, '^//[^/?#]*', '') AS r2
                        FROM (SELECT lower(regexp_extract(s, {scheme_re}, 1)) AS scheme,
                                     regexp_replace(s, {scheme_re}, '') AS r1
                              FROM (SELECT {s} AS s))))))"""


def whitespace_tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: length(x) > 0)"


def md5_key(seed: int, c: str) -> str:
    return f"md5('{seed}|' || CAST({c} AS VARCHAR))"


def hex16(c: str) -> str:
    return f"CAST('0x' || substr({c}, 1, 4) AS INTEGER)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def prompt(instr: str, url: str, url_prefix: bool = True) -> str:
    pre = "'URL: ' || " if url_prefix else ""
    return (f"'<|user|>' || {NL} || {instr} || {NL} || {pre}{url} || '<|end|>' || {NL} "
            f"|| '<|assistant|>' || {NL}")


INSTRUCTION_A = "'Decide if this is phishing and explain why.'"
RULE_ANSWERS = ("Phishing: suspicious keywords", "Legitimate: no indicators",
                "legitimate site, not phishing", "phishing:legitimate: unclear phishing", "no verdict")


def rule_response(url: str) -> str:
    arr = "[" + ", ".join(f"'{a}'" for a in RULE_ANSWERS) + "]"
    return f"({prompt(INSTRUCTION_A, url)} || {arr}[({hex16('md5(' + url + ')')} % 5) + 1])"


def extract_answer(c: str) -> str:
    last = f"list_extract(string_split({c}, '<|assistant|>' || {NL}), -1)"
    return f"regexp_replace({last}, '^\\s+|\\s+$', '', 'g')"


def parse_answer(c: str) -> str:
    low = f"lower({c})"
    head = f"substr({low}, 1, 20)"
    cnt = lambda w: f"((length({low}) - length(replace({low}, '{w}', ''))) // {len(w)})"
    return (f"(CASE WHEN contains({low}, 'phishing') AND NOT contains({head}, 'legitimate:') THEN 1 "
            f"WHEN contains({low}, 'legitimate') AND NOT contains({head}, 'phishing:') THEN 0 "
            f"WHEN {cnt('phishing')} > {cnt('legitimate')} THEN 1 ELSE 0 END)")


def band(c: str, t: float = 0.3) -> str:
    return f"({c} > CAST({t!r} AS DOUBLE) AND {c} < CAST({1.0 - t!r} AS DOUBLE) AND NOT isnan({c}))"


# --- reusable CTE chains ----------------------------------------------------------------

def split_ctes(src: str, seed: int = 42, out: str = "split") -> list[str]:
    """P2 over ``src`` (row_id, label, ...) -> ``out`` with a split column."""
    return [
        f"{out}_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_key(seed, 'row_id')}, row_id) AS _r, "
        f"count(*) OVER (PARTITION BY label) AS _n FROM {src})",
        f"{out} AS (SELECT * EXCLUDE (_r, _n), CASE WHEN _r <= ceil(_n / 5) THEN 'test' "
        f"WHEN _r <= ceil(_n / 5) + ceil((_n - ceil(_n / 5)) / 5) THEN 'validation' ELSE 'train' END AS split "
        f"FROM {out}_r)",
    ]


def nb_ctes(train: str, min_freq: int = 2, p: str = "nb") -> list[str]:
    """M1a on ``train`` (tokens, label) -> ``{p}_w`` (token, c1, c0, weight), ``{p}_b`` (bias)."""
    return [
        f"{p}_ex AS (SELECT label AS _y, unnest(tokens) AS token FROM {train})",
        f"{p}_pt AS (SELECT token, count(*) FILTER (WHERE _y = 1) AS c1, count(*) FILTER (WHERE _y = 0) AS c0 "
        f"FROM {p}_ex GROUP BY token HAVING count(*) >= {min_freq})",
        f"{p}_tot AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM {p}_pt)",
        f"{p}_w AS (SELECT token, c1, c0, ln((c1 + 1.0) / (n1 + 1.0 * v)) - ln((c0 + 1.0) / (n0 + 1.0 * v)) AS weight "
        f"FROM {p}_pt, {p}_tot)",
        f"{p}_b AS (SELECT ln((count(*) FILTER (WHERE label = 1) + 1.0) / (count(*) FILTER (WHERE label = 0) + 1.0)) "
        f"AS bias FROM {train})",
    ]


def score_ctes(src: str, p: str = "nb", out: str = "l1") -> list[str]:
    """M2 over ``src`` (row_id, url, tokens, ...) with model ``p``."""
    return [
        f"{out}_s AS (SELECT e.row_id, sum(w.weight) AS _s FROM (SELECT row_id, unnest(tokens) AS token FROM {src}) e "
        f"JOIN {p}_w w ON e.token = w.token GROUP BY e.row_id)",
        f"{out}_raw AS (SELECT t.*, 1.0 / (1.0 + exp(-((SELECT bias FROM {p}_b) + coalesce(s._s, 0.0)))) AS _p "
        f"FROM {src} t LEFT JOIN {out}_s s ON t.row_id = s.row_id)",
        f"{out} AS (SELECT * EXCLUDE (_p, _e), CASE WHEN _e THEN 0.5 ELSE _p END AS layer1_confidence, "
        f"CASE WHEN _e THEN 0 ELSE CAST(_p > 0.5 AS INTEGER) END AS layer1_prediction, _e AS layer1_error "
        f"FROM (SELECT *, (url IS NULL OR _p IS NULL OR isnan(_p)) AS _e FROM {out}_raw))",
    ]


def cascade_ctes(src: str, out: str = "final", t: float = 0.3, error_col: bool = True) -> list[str]:
    """H1 -> H3 -> rule layer 2 -> H4/H5 -> H8 over ``src`` with layer1 columns."""
    routed_expr = band("layer1_confidence", t)
    if error_col:
        routed_expr = f"(layer1_error OR {routed_expr})"
    return [
        f"{out}_rt AS (SELECT *, coalesce({routed_expr}, false) AS used_layer2 FROM {src})",
        f"{out}_wl AS (SELECT DISTINCT url FROM {out}_rt WHERE used_layer2)",
        f"{out}_l2 AS (SELECT url, {parse_answer(extract_answer('response'))} AS layer2_prediction, "
        f"{extract_answer('response')} AS layer2_explanation, true AS _hit FROM (SELECT url, {rule_response('url')} AS response "
        f"FROM {out}_wl))",
        f"{out} AS (SELECT r.*, CASE WHEN r.used_layer2 AND coalesce(l._hit, false) THEN l.layer2_prediction "
        f"ELSE r.layer1_prediction END AS final_prediction, CASE WHEN r.used_layer2 AND coalesce(l._hit, false) "
        f"THEN l.layer2_explanation ELSE 'Not analyzed by Layer 2' END AS layer2_explanation, "
        f"CASE WHEN r.used_layer2 AND coalesce(l._hit, false) THEN 'Phi3' ELSE 'BiGRU' END AS decision_maker "
        f"FROM {out}_rt r LEFT JOIN {out}_l2 l ON r.url IS NOT DISTINCT FROM l.url)",
    ]


FINAL_COLS = ("row_id, url, layer1_confidence, layer1_prediction, used_layer2, final_prediction, "
              "layer2_explanation, decision_maker")


def url_cascade_ctes() -> list[str]:
    """The flagship chain over ``urls``: -> ``final`` (plus true_label = label)."""
    return [URLS, f"tok AS (SELECT row_id, url, label, {t1('url')} AS tokens FROM urls)",
            *split_ctes("tok"), "train AS (SELECT * FROM split WHERE split = 'train')",
            *nb_ctes("train"), *score_ctes("tok"), *cascade_ctes("l1")]


def fixture_cascade_ctes(out: str = "final") -> list[str]:
    """Cascade over ``scored`` (given confidences) -> ``final``."""
    return [SCORED,
            "sc AS (SELECT *, CAST(layer1_confidence > 0.5 AS INTEGER) AS layer1_prediction FROM scored)",
            *cascade_ctes("sc", out, error_col=False)]
