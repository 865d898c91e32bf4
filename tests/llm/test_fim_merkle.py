"""Fill-in-middle and the Merkle manifest against plain versions and their SQL."""

import hashlib
import re
import zlib

import pytest

from oracle_compare import compare, duck
from urlsieve.llm import fill_in_middle, merkle, queries

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_sql(spark, con, key):
    assert compare(spark, con, key, queries.QUERIES[key], queries.SQL[key], SF)["status"] == "match"


TEXTS = ["a\nb\n\nc", None, "", "\n", "\n\n", "x<P>y\nz", "only", "<S", "one\ntwo\n", "é\U0001d11e\n" * 50 + "tail", "\r\nq\x00\n\tw",
         "l1\nl2 <\nS>l3\n" * 4, "<P\n><M\n>" * 3, "long line " * 300_000 + "\nend"]


def middle_of(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle(spark, rate):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb", "", "", 1), (3, "twice\n" * 9, "", "", 2), (3, "twice\n" * 9, "", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string, h1 int")
    got = fill_in_middle.fill_in_middle(docs, rate=rate).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = [(r[0], *middle_of(r[0], r[1], rate)) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    digests = fill_in_middle.fill_in_middle_digest(docs, rate=rate).collect()
    want = [(r[0], *w[1:5], sha(w[5]), sha(r[1] or "")) for r, w in zip(rows, want)]
    assert sorted(map(tuple, digests), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty_table(spark):
    assert fill_in_middle.fill_in_middle_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if (i ^ 1) < len(level) else "", i & 1))
        i >>= 1
    return out


def plain_manifest(rows):
    def leaf(r, more=0):
        return sha("".join(map(field, (r[0], r[1], r[2], r[3] if r[3] is None else r[3] + more, r[4]))))

    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels([leaf(r) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            siblings = path(tree, i) + path(top, k)
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for s, left in siblings:
                node = sha(s + node if left else node + s)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], sha("".join(s for s, _ in siblings)), node, node == top[-1][0]))
    return out


def _rows(n):
    rows = [(i, f"s{i % 3}" if i % 11 else None, ["en", "fr", None, "de", "é"][min(i % 7, 4)], None if i % 13 == 0 else i,
             None if i % 17 == 0 else "t" * (i % 30) + "é") for i in range(n)]
    return rows + [(None, "a", "en", 3, "x"), (5, "dup", "en", 1, "y"), (77, "q", "xx", 1, "lone"), (0, "", "", 0, ""), *[(9, "same", "fr", 1, "z")] * 300]


@pytest.mark.parametrize("rows", [_rows(1500), _rows(20), _rows(3)[:1], _rows(3)[:2], []], ids=["blocks", "few", "one", "two", "none"])
def test_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, block int")
    got = merkle.verified_manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(rows) if rows else [], key=repr)


def test_manifest_finds_any_change(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(_rows(200), "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.manifest(docs, tampered={"text": F.when(F.col("doc_id") == 11, "other").otherwise(F.col("text"))})
    ok = rows.select("doc_id", (merkle.folded(F.col("claim"), F.col("siblings")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in ok if not r.ok} == {11}


def test_manifest_writes_narrow_rows(spark, monkeypatch):
    """Readers take up thousands of rows at a time, so no written row holds a block or its siblings."""
    widest = {}

    def written(df, name):
        out = materialise(df, name)
        widest[name] = out.selectExpr("max(length(to_json(struct(*)))) AS n").head().n or 0
        return out

    materialise = merkle.materialise
    monkeypatch.setattr(merkle, "materialise", written)
    docs = spark.createDataFrame(_rows(1500), "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verified_manifest(docs).count() == len(_rows(1500))
    assert max(widest.values()) < 500, widest
