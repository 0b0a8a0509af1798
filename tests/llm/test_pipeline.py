from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import mixing, quality, simhash_dedup
from tallyforge.llm import exact_dedup as dedup

SF = "/root/testdata/sf0.001"


def stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = f"file://{tmp_path}/{name}"
        found = stage(spark, docs, SF)
        found.write.parquet(out)
        kept = spark.read.parquet(out)
        yield name, docs, kept
        docs = kept


def rows(df):
    return df.select("doc_id", "text", "source").collect()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def waterfill(size, sources):
    """Targets of the sources: weights 3, 1, 2 in turn, 150 % of all words, at most twice a source's words."""
    total = Counter()
    for i, n in size.items():
        total[sources[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    target, left = {}, set(total)
    while left:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * total[s]}
        if not full:
            return target | {s: weight[s] * level for s in left}
        target |= {s: 2 * total[s] for s in full}
        left -= full
    return target


def test_every_stage_against_a_plain_version(spark, tmp_path):
    for name, before, after in stages(spark, tmp_path):
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r.doc_id for r in after.collect()}
            good = [r.doc_id in kept for r in rows(before) if labels.get(r.doc_id) == 1]
            bad = [r.doc_id in kept for r in rows(before) if labels.get(r.doc_id) == 0]
            assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
            ranker, _ = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == {r.doc_id for r in rows(before) if float(quality.features((r.text or "").encode()).astype("float32") @ ranker.weights) >= ranker.threshold}
        elif name == "exact":
            first = {}
            for r in sorted(rows(before), key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
        elif name == "near":
            own = rows(before)
            sets = [shingles(r.text) for r in own]
            label = list(range(len(own)))
            for a in range(len(own)):
                for b in range(a):
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                        old, new = label[a], label[b]
                        label = [new if k == old else k for k in label]
            least = {}
            for r, k in zip(own, label, strict=True):
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())
        elif name == "mixture":
            size, copies = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows(before)}, Counter(r.doc_id for r in after.collect())
            sources = {r.doc_id: r.source for r in rows(before)}
            for source, target in waterfill(size, sources).items():
                own = [i for i in size if sources[i] == source]
                per = target / max(1, sum(size[i] for i in own))
                assert all(int(per) <= copies[i] <= int(per) + 1 for i in own)
                assert abs(sum(size[i] * copies[i] for i in own) - target) <= max(size[i] for i in own)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = Counter()
            for r in rows(before):
                ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
                want.update((r.doc_id, k, tuple(ids[k : k + 1024])) for k in range(0, len(ids), 1024))
            found = after.collect()
            assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in found) == want
            used = Counter()
            for r in found:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 1024
            assert sum(1024 - n for n in used.values()) <= 0.1 * sum(used.values())


def test_run_is_the_same_as_its_stages(spark, tmp_path):
    *_, (_, _, last) = stages(spark, tmp_path)
    pick = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, SF)) == pick(last)


LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(40_000))
BASE = " ".join(f"term{k}" for k in range(44))  # 40 shingles
ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \t ", "en", None, 3), (4, "same  text here", "en", "b", 1), (4, "same  text here", "en", "b", 1), (6, "same text here", None, "a", 1),
    (None, "same\ttext here", "en", None, None), (None, None, None, None, None), (7, LONG, "de", "b", 1), (8, LONG, "de", "a", 1), (9, LONG + " end", "de", "a", 1), (11, BASE, "en", "a", 1),
    (12, BASE + " and eight more words than it did before", "en", "a", 1), (13, BASE + " and twelve more words than it ever had before this one came up", "en", "a", 1),
]
PLAIN = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the stages use inside, and one with a dot.
EXTRA = ["at_file", "at_row", "copies", "score", "digest", "key", "first", "doc", "label", "a.b", "size", "part"]


def stored(spark, tmp_path, rows, schema=PLAIN):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = stored(spark, tmp_path, ODD)
    all_of = Counter((r.doc_id, r.text) for r in docs.collect())

    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, SF).collect())
    assert all(kept[x] in (0, all_of[x]) for x in all_of) and not kept - all_of
    assert len({kept[x] > 0 for x in all_of if not x[1]}) == 1

    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, SF).collect())
    assert kept == Counter([(1, None), (3, " \t "), (4, "same  text here"), (7, LONG), (9, LONG + " end"), *((i, t) for i, t, *_ in ODD if i in (11, 12, 13))])

    # Of 40 shingles, 8 more are a similarity of 40 / 48, and 12 more of 40 / 52; the last two texts share no more.
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, SF).collect())
    assert kept == Counter([(1, None), (4, "same  text here"), (7, LONG), (11, BASE), (13, ODD[-1][1])])

    taken = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    assert set(taken) <= set(all_of) and all(taken[x] <= 2 * all_of[x] for x in taken)
    assert taken == Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs, SF).collect())

    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.length) for r in pieces if r.doc_tokens == 1) == Counter([(1, 1), (2, 1), (None, 1)])
    assert sum(r.start == 0 for r in pieces) == len(ODD)
    assert {r.doc_id for r in pieces if r.length == 1024} == {7, 8, 9}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, tmp_path, name):
    docs = stored(spark, tmp_path, [])
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert found.count() == 0
    assert name == "packing" or found.columns == corpus_pipeline.COLUMNS


def test_columns_with_the_names_that_stages_use(spark, tmp_path):
    schema = PLAIN + "".join(f", `{c}` string" for c in EXTRA)
    docs = stored(spark, tmp_path, [(*row, *(f"{c}{k}" for c in EXTRA)) for k, row in enumerate(ODD[:7] + ODD[11:])], schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    every = {tuple(r) for r in docs.collect()}
    for found in (quality.keep_good(docs, labels), dedup.drop_copies(docs), simhash_dedup.drop_near_copies(docs), mixing.take_mix(docs)):
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} <= every
    assert corpus_pipeline.packing(spark, docs, SF).where("start = 0").count() == 10
