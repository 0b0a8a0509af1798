from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm import exact_dedup, near_copies, simhash_dedup
from tallyforge.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, at_file string, digest int"


def table(spark, tmp_path, rows, parts=3):
    path = str(tmp_path / "documents.parquet")
    full = [(i, t, "en", "s", None, "clash", "clash", 1) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (1, None), (2, ""), (7, "x" * 200_000), (8, "x" * 200_000), (8, "x" * 200_000), (4, "é\u00a0b"), (6, " ")]


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup_matches_brute_force(spark, tmp_path, files):
    docs = table(spark, tmp_path, ROWS)
    found = exact_dedup.exact_dedup(docs, files_per_batch=files).collect()
    groups = brute_groups(ROWS)
    assert len(found) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in found) == len(groups)


def test_exact_dedup_compares_bytes_where_digests_clash(spark, tmp_path):
    docs = table(spark, tmp_path, ROWS)
    weak = lambda text: F.unhex(F.hex(F.length(text) % 2))
    found = exact_dedup.exact_dedup(docs, digest=weak).collect()
    assert sorted((r.doc_id or -1, r.group_size, r.kept) for r in found) == sorted((r.doc_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())


def test_a_kept_state_takes_further_deliveries(spark, tmp_path):
    path, state = str(tmp_path / "documents.parquet"), f"file://{tmp_path}/kept"
    judged = lambda found: Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect())
    for rows in (ROWS, [(0, "a b"), (12, "new"), (13, "new")], []):
        if rows:
            spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash", 1) for i, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        docs = spark.read.parquet(path)
        assert judged(exact_dedup.exact_dedup(docs, state=state)) == judged(exact_dedup.exact_dedup(docs))
    assert spark.read.parquet(f"{state}/digests").count() == len(ROWS) + 3
    updates = spark.read.parquet(f"{state}/first-seen").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in updates} == {0: len(brute_groups(ROWS)), 1: 2}
    with pytest.raises(ValueError, match="table of files"):
        exact_dedup.exact_dedup(docs.where("doc_id > 1"), state=state)


def test_drop_copies_keeps_columns(spark, tmp_path):
    docs = table(spark, tmp_path, ROWS)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(brute_groups(ROWS))


def test_empty_tables(spark, tmp_path):
    docs = table(spark, tmp_path, [])
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert simhash_dedup.simhash_dedup(docs).count() == 0
    assert simhash_dedup.drop_near_copies(docs).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_covering_masks_leave_no_pair_out(radius):
    masks = simhash_dedup.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not flips & m for m in masks)
    assert all(m.bit_count() >= 25 for m in masks)


@pytest.mark.parametrize("block", [3, 512])
def test_simhash_components_match_brute_force(spark, tmp_path, block, monkeypatch):
    rng = random.Random(4)
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 60)) for _ in range(300)]
    rows = [(1000, None), (1001, ""), (1002, "One"), (1003, "one "), (None, "É two three"), (1004, "w" * 100_000)]
    for i in range(120):
        words = list(base) if i < 90 else [f"{w}{i}" for w in base]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((500 + i, " ".join(words).upper()))
    plain = simhash_dedup.simhash_links
    monkeypatch.setattr(simhash_dedup, "simhash_links", lambda fps, radius: plain(fps, radius, block))
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.simhash_dedup(table(spark, tmp_path, rows)).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    label = list(range(len(rows)))
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(prints), 2):
        if (x ^ y).bit_count() <= 4 and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if k == old else k for k in label]
    for k, (i, x) in enumerate(prints):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        assert found[i, f"{x:016x}"] == min(ids, default=None)
    kept = simhash_dedup.drop_near_copies(spark.read.parquet(str(tmp_path / "documents.parquet")), simhash_dedup.Likeness())
    assert kept.count() == len(set(label))


def test_forest_connects_as_links_do():
    rng = np.random.default_rng(3)
    values = (rng.integers(0, 1 << 9, 40) << 20).astype(np.int64)
    values = np.unique(values)
    for radius in (1, 2):
        edges = simhash_dedup._forest(values, radius)

        def classes(pairs):
            label = {int(v): int(v) for v in values}
            for a, b in pairs:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            return label

        full = [(int(a), int(b)) for a, b in itertools.combinations(values, 2) if int(a ^ b).bit_count() <= radius]
        assert classes(edges) == classes(full)


def test_components_of_a_path_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert found == want


def test_near_copies_by_five_words(spark, tmp_path):
    rng = random.Random(9)
    rows, near = [], 0
    for i in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
        rows.append((i, " ".join(words)))
        for k in range(2):
            edited = list(words)
            edited[rng.randrange(300)] = "edited"
            rows.append((100 + 10 * i + k, " ".join(edited)))
            near += 1
    rows += [(5000 + i, " ".join(f"u{rng.randint(0, 400)}" for _ in range(8))) for i in range(40)]
    left = {r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, tmp_path, rows)).collect()}
    assert {i for i, _ in rows if i < 100 or i >= 5000} <= left
    assert len(left) - 100 <= 0.05 * near


@pytest.mark.parametrize("block", [2, 128])
def test_near_copies_are_those_of_exact_similarity(spark, tmp_path, block, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        rows.append((100 * i, " ".join(words)))
        for k in range(4):
            edited = list(words)
            for at in rng.sample(range(300), rng.randint(3, 12)):
                edited[at] = f"edit{rng.randint(0, 5000)}"
            rows.append((100 * i + k + 1, " ".join(edited).upper()))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    label, close, apart = list(range(len(rows))), 0, 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        likeness = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        close += 0.8 <= likeness < 0.85
        apart += 0.65 <= likeness < 0.8
        if likeness >= 0.8 and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if k == old else k for k in label]
    assert close > 30 and apart > 100
    plain = near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda distinct, docs: plain(distinct, docs, block, 1000 * block))
    left = sorted(r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, tmp_path, rows)).collect())
    assert left == sorted(rows[k][0] for k in set(label))


def test_near_links_go_by_fingerprints(spark, tmp_path):
    """Without any band, copies of near fingerprints are joined; apart are those that are near but less than 0.8 alike, and the rest."""
    words = [f"w{k}" for k in range(300)]
    texts = {1: words, 2: ["x", *words], 3: [*words, "y"], 4: [f"v{k}" for k in range(300)], 5: [], 6: words[:200] + [f"z{k}" for k in range(100)]}
    docs = table(spark, tmp_path, [(i, " ".join(w)) for i, w in texts.items()])
    rows = near_copies.addressed(docs, "doc_id", "text")
    schema = "doc_id bigint, at_file bigint, at_row bigint, key bigint, shingles bigint, fp bigint, bands array<bigint>"
    prints = rows.mapInArrow(near_copies._prints, schema).withColumn("bands", F.array().cast("array<bigint>")).withColumn("first", F.struct("doc_id", "at_file", "at_row"))
    keys = {r.key: r.doc_id for r in prints.collect()}
    groups = {}
    for r in near_copies.near_links(prints, docs).collect():
        groups.setdefault(r.root, set()).add(keys[r.node])
    assert list(groups.values()) == [{1, 2, 3}]


def test_hot_keys_cost_no_rows(spark, tmp_path):
    """Nine tenths of the rows are one text and one id."""
    rows = [(7, "the same words once and again")] * 900 + [(1000 + i, f"text number {i} of its own") for i in range(100)]
    docs = table(spark, tmp_path, rows)
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == 1000 and sum(r.kept for r in found) == 101
    assert {r.group_size for r in found if r.doc_id == 7} == {900}
    assert simhash_dedup.simhash_dedup(docs).where("kept").count() <= 101
    left = simhash_dedup.drop_near_copies(docs)
    assert left.where("doc_id = 7").count() == 1 and left.count() == 101


def test_fingerprints_are_masked_in_many_tasks(spark, monkeypatch):
    """A fingerprint is a row for each mask where it is read; its table is one small file, which would be one task of all these rows."""
    given, links = [], near_copies.simhash_links
    monkeypatch.setattr(near_copies, "simhash_links", lambda fps, radius: given.append(fps.rdd.getNumPartitions()) or links(fps, radius))
    distinct = spark.createDataFrame([(k, 5, fp) for k, fp in enumerate([0, 0, 63, 127, -1])], "key bigint, shingles bigint, fp bigint")
    found = {frozenset((r.u, r.v)) for r in near_copies.fingerprint_pairs(distinct).collect()}
    assert {frozenset((0, 1)), frozenset((0, 2))} <= found and not any(4 in pair for pair in found)
    assert given == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
