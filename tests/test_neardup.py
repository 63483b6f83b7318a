"""Near duplicates by MinHash bands against exact Jaccard; the rest of the library without the corpus operators."""

import os
import random
import subprocess
import sys
from itertools import combinations

import pyarrow as pa

from ledgerleaf.operators import neardup as nd

SCHEMA = "doc_id long, text string"


def windows(text):
    w = " ".join((text or "").lower().split()).split(" ")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w != [""] else set()


def exact_components(rows):
    sets = {i: windows(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return links, {i: root(i) for i in sets}


def texts(groups, copies, pick):
    """Groups of texts that differ from each other in some places, near the threshold on both sides."""
    rows = []
    for g in range(groups):
        base = [f"w{pick.randrange(3000)}" for _ in range(pick.randrange(40, 150))]
        for c in range(copies):
            own = list(base)
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = f"x{pick.randrange(3000)}"
            rows.append((g * copies + c, " ".join(own)))
    return rows


def test_no_link_is_lost(spark):
    pick = random.Random(8)
    rows = texts(40, 8, pick)
    rows += [(1000 + i, "shared passage of ten words that many documents hold here " * 2 + " ".join(f"u{i}v{k}" for k in range(60))) for i in range(100)]
    rows += [(5000, None), (5001, ""), (5002, "two words"), (5003, "Two  WORDS"), (None, "two words"), (5004, "word " * 30_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    links, want = exact_components(rows)
    found = nd.near_links(docs)
    assert {(r.a, r.b) for r in found.collect()} <= set(links)
    got = {r.id: r.component for r in nd.components(found).collect()}
    lost = {i: (got.get(i, i), c) for i, c in want.items() if got.get(i, i) != c}
    assert not lost
    kept = sorted((r.doc_id for r in nd.near_dedup(docs).collect()), key=str)
    assert kept == sorted([i for i, c in want.items() if i == c] + [None], key=str)


def test_recall_of_bands(spark):
    """Share of linked pairs that meet in a band."""
    rows = texts(60, 6, random.Random(2))
    links, _ = exact_components(rows)
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", nd.band_keys(nd.text_windows("text")).alias("keys"))
    keys = {r.doc_id: r["keys"] for r in docs.collect()}
    met = [any(x == y for x, y in zip(keys[a], keys[b])) for a, b in links]
    assert len(met) > 300 and all(met)


def test_large_group_of_copies_and_empty_table(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{base} end{i}") for i in range(3000)], SCHEMA)
    assert [r.doc_id for r in nd.near_dedup(docs).collect()] == [0]
    assert nd.near_dedup(docs.limit(0)).count() == 0


def crowd(texts, pairs, pick):
    """Texts of one template, few of them near each other, and some with a near text each."""
    base = [f"w{i}" for i in range(200)]

    def changed(words, places, tag):
        own = list(words)
        for k, at in enumerate(pick.sample(range(len(own)), places)):
            own[at] = f"{tag}x{k}"
        return own

    rows = [changed(base, 5, f"a{i}") for i in range(texts)]
    rows += [changed(own, 4, f"b{i}") for i, own in enumerate(rows[:pairs])]
    return [(i, " ".join(own)) for i, own in enumerate(pick.sample(rows, len(rows)))]


def components_of(rows, links):
    got = {r.id: r.component for r in nd.components(links).collect()}
    return {i: got.get(i, i) for i, _ in rows if i is not None}


def test_near_texts_in_a_crowd_are_linked(spark):
    """Texts that share their buckets with many they are not near to."""
    rows = crowd(400, 40, random.Random(5))
    links, want = exact_components(rows)
    assert 40 < len(links) < 400
    found = nd.near_links(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {(r.a, r.b) for r in found.collect()} <= set(links)
    assert components_of(rows, found) == want


def test_no_link_is_lost_whatever_the_signatures_find(spark, monkeypatch):
    pick = random.Random(12)
    rows = texts(30, 6, pick) + [(900 + i, t) for i, t in crowd(40, 10, pick)]
    rows += [(2000, "a b"), (2001, "A  b"), (2002, "a b c"), (2003, "word " * 20), (2004, "word " * 9), (2005, None), (2006, " "), (None, "a b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    links, want = exact_components(rows)
    monkeypatch.setattr(nd, "TILE", 2)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 5)
    found = nd.near_links(docs, bands=1, rows=12)
    assert {(r.a, r.b) for r in found.collect()} <= set(links)
    assert components_of(rows, found) == want


def test_texts_whose_windows_meet_others(monkeypatch):
    """Against a plain version: none too few, and beyond it only those at the ends and in long runs."""
    monkeypatch.setattr(nd, "_HELD", 6)
    pick = random.Random(4)
    for size in (1, 2, 3, 50):
        rows = sorted((pick.randrange(25), pick.randrange(3), i) for i in range(60)) + [(30, 0, 100 + i) for i in range(8)] + [(31, 1, 5), (32, 0, 6), (32, 2, 7)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(("window", "label", "id"), r)) for r in rows[at:at + size]]) for at in range(0, len(rows), size)]
        given = sorted(i for b in nd._meeting(iter(batches)) for i in b.column("id").to_pylist() if i < 100)  # the long run may be told of
        labels = {}
        for window, label, _ in rows:
            labels.setdefault(window, set()).add(label)
        ends = {rows[0][0], rows[-1][0]}
        assert given == sorted(i for w, _, i in rows if len(labels[w]) > 1 or w in ends)
    assert not list(nd._meeting(iter(())))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(900, 901)], "a long, b long")
    got = {r.id: r.component for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_the_rest_runs_without_the_corpus_operators():
    """Imports and registers everything else, and runs what once needed them, while they cannot be imported."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.split(".")[:2] == ["ledgerleaf", "llm"]:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from ledgerleaf.session import build_session
names = entry.queries()
assert len(names) > 130 and not any(n.startswith("op") and n[2].isdigit() for n in names) and set(entry.oracle_sql()) <= set(names)
spark = build_session(master="local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert names["near_deduped_documents"](spark, "/root/testdata/sf0.001").count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.getcwd(), capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
