import hashlib
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, registry

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level, fanout):
    """The top of a list of digests, and what stands beside each on the way up."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k // fanout * fanout
            paths[i].append((level[first:k], level[k + 1 : first + fanout]))
            at[i] = k // fanout
        level = [digest("".join(level[a : a + fanout])) for a in range(0, len(level), fanout)]
    return level[0], paths


def expected(rows, fanout=2):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, text, lang, source, n in rows:
        same = (i, source, lang, n, text)
        bad = i is not None and n is not None and crc32(str(i).encode()) % 7 == 0
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf_of(same), leaf_of((i, source, lang, n + 1, text)) if bad else None, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names]
    if not low:
        return []
    root, high = tree([top for top, _ in low], fanout)
    out = []
    for g, (top, paths), upper in zip(names, low, high, strict=True):
        for (_, _, leaf, claimed, i), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            path, x = path + upper, claimed or leaf
            for before, after in path:
                x = digest("".join(before) + x + "".join(after))
            out.append((i, leaf, top, root, digest("".join("".join(a + b) for a, b in path)), x, x == root))
    return sorted(out, key=str)


def rows_of(n, langs=("en", "de", None, "é")):
    return [(i * 37 % 1000, None if i % 11 == 0 else f"text {i} é" * (i % 4), langs[(i * i) % len(langs)], None if i % 5 == 0 else f"s{i % 3}", None if i % 13 == 0 else i) for i in range(n)]


CASES = {
    "none": [],
    "one": rows_of(1),
    "one language": [(i, "t", "en", "s", 1) for i in range(9)],
    "odd runs": rows_of(77),
    "lone leaves": [(i, "t", f"l{i}", "s", 1) for i in range(5)],
    "nulls": [(None, None, None, None, None), (None, "", "", "", 0), (3, None, None, "-", None)],
    "repeats": [(7, "same", "en", "s", 4)] * 6 + [(7, "other", "en", "s", 4), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)],
    "long": [(i, "word " * 40_000 + str(i), "en", "s", 2**63 - 1) for i in range(3)],
}


def mine(spark, rows, tmp_path, fanout=2):
    spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("a column in the way")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_plain_python(spark, tmp_path, name):
    mine(spark, CASES[name], tmp_path)
    got = registry.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(CASES[name])


def test_other_fanouts(spark, tmp_path):
    docs = mine(spark, rows_of(60), tmp_path)
    for fanout in (3, 16):
        got = merkle.verified(merkle.manifest(docs, FIELDS, "doc_id", "lang", fanout))
        want = [(i, leaf, sub, root, proof) for i, leaf, sub, root, proof, _, _ in expected([r[:5] for r in rows_of(60)], fanout)]
        rows = got.collect()
        assert sorted((tuple(r)[:4] + (r.proof_sha256,) for r in rows), key=str) == want
        assert all(r.verified for r in rows)


def test_a_changed_document_leads_elsewhere(spark, tmp_path):
    docs = mine(spark, rows_of(20), tmp_path)
    claimed = F.when(F.col("doc_id") == 37, merkle.leaf(*[F.lit("forged") if f == "text" else F.col(f) for f in FIELDS]))
    rows = merkle.verified(merkle.manifest(docs, FIELDS, "doc_id", "lang", 4, claimed)).collect()
    assert {r.doc_id for r in rows if not r.verified} == {37}


def test_sql_gives_the_same(spark, tmp_path):
    rows = [r for r in rows_of(50) if r[0] is not None]
    mine(spark, rows, tmp_path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.execute(registry.OP11_SQL).fetchall(), key=str) == expected(rows)
