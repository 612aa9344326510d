import hashlib
import re
from collections import defaultdict

import pytest

from cinderlake.llm import secrets

from .helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def brute(t):
    t = t or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(said.encode()).hexdigest(), said


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_base_equals_brute_force(spark, source):
    rows = awkward() if source == "awkward" else [(r.doc_id, r.text, r.lang, r.source, 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*rows, (77, "\U0001f600Key ſecret: abcdefg toKen=abcdefgh SECRET : 'q1/w2+e3' token=ab", "en", "z", 1)]
    got = defaultdict(list)
    for r in secrets.digest_columns(secrets.scan_secrets(frame(spark, rows))).collect():
        got[r.doc_id].append(r)
    for d, t, *_ in rows:
        *n, sha, said = brute(t)
        for r in got[d]:
            if sum(1 for x in rows if x[0] == d) == 1 or d == 6:
                assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, sha)
                assert {*filter(None, said.split(","))} <= {*filter(None, r.spans.split(","))}
    assert sum(map(len, got.values())) == len(rows)


def test_ownership_separates_examples_from_live(spark):
    shared, own = "Xk9mQ2vLp8RtYw3ZbN7cJd5F", "Qz7LmW4xT9vBn2KcR8pYd6Hj"
    rows = [(i, f"see {shared} here", "en", f"s{i}", 1) for i in range(6)] + [(10, f"key {own}", "en", "s1", 1), (11, f"key {own}", "en", "s1", 1), (12, f"password={shared}", "en", "s9", 1)]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert all(got[i].spans == [] for i in range(6))  # an example of many owners is no added span
    assert [s.verdict for s in got[10].spans] == ["live"] and got[10].spans[0].n_owners == 1 and got[10].spans[0].n_repos == 2
    assert got[12].spans[0].base and got[12].spans[0].verdict == "example"  # base spans stay


def test_empty(spark):
    assert secrets.digest_columns(secrets.scan_secrets(frame(spark, []))).count() == 0
