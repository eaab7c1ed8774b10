import hashlib
from collections import defaultdict

import numpy as np

from tests.oracle import duck, same
from weirflow.llm import exact_dedup, line_dedup
from weirflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_oracles(spark):
    con = duck(SF)
    for name in ORACLES:
        assert same(spark, con, QUERIES[name], ORACLES[name], SF) == "", name


def test_exact_dedup_edges(edge):
    docs = edge.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in docs:
        groups[r.text or ""].append(r.doc_id)
    out = exact_dedup.exact_dedup(edge).collect()
    assert len(out) == len(docs)
    least = -1
    by_sha = {sha(t): ids for t, ids in groups.items()}
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert (least if r.keep_id is None else r.keep_id) == max(least if i is None else i for i in ids)
    for digest in by_sha:
        assert sum(r.kept for r in out if r.text_sha256 == digest) == 1


def test_exact_dedup_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0


def brute_lines(docs, min_docs, min_chars):
    table = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.strip(line_dedup.STRIPPED).translate(table)
    holders = defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        lost = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(lost), sha("\n".join(x for x, y in zip(lines, lost, strict=True) if not y))))
    return sorted(out)


def lines_of(state, docs):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.clean(state, docs).collect())


def test_line_dedup_is_reversible(spark):
    a, b = "A line that is long enough to count as one, surely.", "Another line, long enough too, of forty signs and more."
    first = [(k, f"{a}\nown {k}\n {b.upper()}\t") for k in range(1, 5)]
    second = [(k, f"{b}\n{a}\n{a}") for k in range(5, 8)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = line_dedup.insert(line_dedup.empty_state(spark), make(first))
    assert lines_of(one, make(first)) == brute_lines(first, 5, 40)
    both = line_dedup.insert(one, make(second))
    assert lines_of(both, make(first + second)) == brute_lines(first + second, 5, 40)
    back = line_dedup.delete(both, make(second).select("doc_id"))
    assert lines_of(back, make(first)) == brute_lines(first, 5, 40)
    less = line_dedup.delete(both, make([(7, None)]).select("doc_id"))
    assert lines_of(less, make(first + second[:2])) == brute_lines(first + second[:2], 5, 40)


def test_line_dedup_with_many_shards(spark, monkeypatch):
    """Filters that are too many to send meet the refs of their shard, of which one line holds most; so after a deletion."""
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 4)
    monkeypatch.setattr(line_dedup, "PASS_BYTES", 0)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 16)
    lines = [f"line number {k} is one of thirty that some documents share" for k in range(30)]
    docs = [(k, "\n".join([lines[0], lines[k % 30], f"own words of {k}", lines[k * 7 % 30]])) for k in range(200)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = line_dedup.insert(line_dedup.empty_state(spark), make(docs))
    assert state.shards > 8
    assert lines_of(state, make(docs)) == brute_lines(docs, 5, 40)
    fewer = line_dedup.delete(state, make(docs[:100]).select("doc_id"))
    assert lines_of(fewer, make(docs[100:])) == brute_lines(docs[100:], 5, 40)


def test_line_dedup_edges(edge, nothing):
    out = line_dedup.line_dedup(edge, min_docs=2, min_chars=10).collect()
    assert len(out) == edge.count()
    kept = {r.doc_id: r for r in out if r.doc_id is not None}
    assert kept[3].n_lines == kept[4].n_lines == 1 and kept[3].kept_sha256 == sha("")
    assert kept[1].n_dropped == 1 and kept[10].n_dropped == 0
    assert line_dedup.line_dedup(nothing).count() == 0


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    f = line_dedup.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = rng.integers(-(1 << 62), 1 << 62, 20000)
    assert line_dedup.CuckooFilter.loads(f.dumps()).contains(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
