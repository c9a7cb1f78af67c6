"""Every op query over the smallest tables against a slow version of what it has to return."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from reelhouse.llm import pii
from reelhouse.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_llm import brute_lines, reach, slow_fingerprint

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def texts():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def found(spark):
    rows = {}

    def of(name):
        if name not in rows:
            rows[name] = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
        return rows[name]

    return of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(found, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in found(name)))) == sorted(map(repr, want.fetchall()))


def test_op1(found):
    import tiktoken

    from reelhouse.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in found("op1_bpe_round_trip"):
        text = texts()[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))


def base_spans(text):
    """The patterns of the contract by Python's own matcher."""
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2]) + sum(map(int, d[-1::-2]))
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and odd % 10 == 0, 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op4(found):
    some = 0
    for r in found("op4_personal_data"):
        base = base_spans(texts()[r["doc_id"]])
        some += len(base)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == sha(listed(base))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [":".join(s) for s in spans if s[0] in pii.BASE] == [x for x in listed(base).split(",") if x]
        added = [(int(a), int(b)) for k, a, b in spans if k not in pii.BASE]
        assert all(a < b and not any(a < e and s < b for s, _, e in base) for a, b in added)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))
    assert some > 10


def test_op5(found):
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    right = []
    for r in found("op5_quality"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(r["predicted"] == labels[r["doc_id"]])
    assert right and np.mean(right) >= 0.8


def test_op7(found):
    own = sorted(texts().items())
    want = dict(zip((k for k, _ in own), brute_lines([t for _, t in own])))
    got = {r["doc_id"]: r for r in found("op7_line_dedup")}
    assert set(got) == set(want)
    wrong = [d for d, t in want.items() if got[d]["kept_sha256"] != sha(t)]
    assert len(wrong) <= 0.01 * len(want)
    for d, t in want.items():
        assert got[d]["n_lines"] == texts()[d].count("\n") + 1
        left = t.count("\n") + 1 if t else 0
        assert d in wrong or got[d]["n_removed"] in (got[d]["n_lines"] - left, got[d]["n_lines"] - left - 1)
        # Nothing but what brute force drops is dropped.
        assert got[d]["n_removed"] <= max(0, got[d]["n_lines"] - left)


def test_op8(found):
    prints = {d: slow_fingerprint(t) for d, t in texts().items()}
    root = reach(sorted(set(prints.values())))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found("op8_simhash")}
    assert got == {d: (f"{p:016x}", least[root[p]]) for d, p in prints.items()}
