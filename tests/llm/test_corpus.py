from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import language_model, media, mixing, packing, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, score string, place int"


def table(spark, tmp_path, rows, name="documents"):
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(i, t, "en", s, None, 1, "x", 1) for i, t, s in rows], SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


ROWS = [(1, None, "a"), (2, "", "a"), (3, "Hello world hello", "b"), (3, "Hello world hello", "b"), (None, "é x", None), (5, "word " * 30_000, "a"), (6, "one two three", "b")]


def waterfill(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, total = {}, set(order), share * sum(sizes.values())
    while left:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in left}
        target |= {s: most * sizes[s] for s in full}
        left -= full
    return target


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets_match_water_filling(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        sizes = {f"s{k:02d}": int(x) for k, x in enumerate(rng.integers(0, 10_000, n))} | {None: 17}
        rows = mixing.source_targets(spark.createDataFrame([(s, float(x)) for s, x in sizes.items()], "source string, source_size double")).collect()
        want = waterfill(sizes)
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) for r in rows)


@pytest.mark.parametrize("group", [4, 4096])
def test_mix_meets_targets_and_reruns_agree(spark, tmp_path, group):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{i % 3 if i % 2 else 0}") for i in range(300)] + ROWS
    docs = table(spark, tmp_path, rows)
    found = mixing.mix(docs, group=group).collect()
    assert len(found) == len(rows)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs, group=group).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = waterfill(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
    by_size = {s: (want[s], sizes[s]) for s in want}
    for t, size in by_size.values():
        own = [r for r in found if math.isclose(r.target, t, rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size]
        assert own
        assert abs(sum(r.taken for r in own) - t) <= max(r.size for r in own) * (1 if len(own) else 0) + 1e-6
    total = sum(r.copies for r in found)
    assert mixing.take_mix(docs, group=group).count() == total
    assert mixing.take_mix(docs).columns == docs.columns


def test_mix_of_nothing(spark, tmp_path):
    docs = table(spark, tmp_path, [])
    assert mixing.mix(docs).count() == 0
    assert mixing.take_mix(docs).count() == 0


RANKS, PATTERN, SPECIAL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def test_first_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 500).tolist()
    bins, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((k for k, room in enumerate(bins) if room >= lengths[i]), None)
        if b is None:
            b = len(bins)
            bins.append(1024)
        bins[b] -= lengths[i]
        want[i] = b
    assert packing.first_fit_decreasing(lengths, 1024)[0] == want


def test_pack_is_whole_and_tight(spark, tmp_path):
    rows = [*ROWS, *((i, f"Text <|endoftext|> number {i}, " * (i % 17), "s") for i in range(10, 200))]
    docs = table(spark, tmp_path, rows)
    found = packing.pack(docs, RANKS, PATTERN, SPECIAL, group=64).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            want[i, start, len(piece), len(ids), crc32(np.array(piece, "<u4").tobytes())] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.doc_tokens, r.ids_crc32) for r in found.itertuples())
    assert got == want
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert own["length"].sum() <= 1024
    assert all(crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found.itertuples())
    assert packing.pack(table(spark, tmp_path, [], "none"), RANKS, PATTERN, SPECIAL).count() == 0


def test_ids_of_any_text_are_those_of_tokenizers():
    """Runs of millions of one character, before, between and after words, and odd strings."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.encoder(RANKS, PATTERN, SPECIAL)
    texts = [c * n for c in (" ", "\n", "a", "^") for n in (30_000, 3_000_000)]
    texts += [f"it's{c * n}we'll{c * 12_000}{tail}" for c in (" ", "\n", "\u2003", "\x85", "\x1c") for n in (9_999, 20_001) for tail in ("", "!", "x y")]
    texts += ["", " ", "a\x00b", "é\u200b\ufeff", "x <|endoftext|><|endoftext|>\n y", " \n" * 8_000 + "z"]
    for text in texts:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (text[:20], len(text))


def png_rows(media):
    """The samples of a greyscale PNG of 8 bits, read by the format's rules for filters 0 to 2."""
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data, width, height = 8, b"", 0, 0
    while at < len(media):
        n, name = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        assert zlib.crc32(name + body) == int.from_bytes(media[at + 8 + n : at + 12 + n], "big")
        if name == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert list(body[8:]) == [8, 0, 0, 0, 0]
        data += body if name == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(data)
    assert len(raw) == height * (width + 1)
    assert not any(raw[:: width + 1])
    return b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_stored_bytes_are_the_texts_by_another_reader(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    rows = [*ROWS, (8, "hot", "a"), *((50 + i, "hot", "a") for i in range(200))]
    found = media.media_columns(table(spark, tmp_path, rows), f"file://{root}").collect()
    want = Counter()
    for i, text, _ in rows:
        data = (text or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
        n, counts = len(payload), Counter(payload)
        mean = sum(payload) / n
        spread = math.sqrt(sum(k * (b - mean) ** 2 for b, k in counts.items()) / n)
        entropy = abs(sum(k / n * math.log2(k / n) for k in counts.values()))
        want[i, len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};distinct={len(counts)}"] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in found) == want
    for r in found:
        with open(root / r.shard, "rb") as shard:
            shard.seek(r.offset)
            stored = shard.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes
        assert hashlib.sha256(png_rows(stored)).hexdigest() == r.payload_sha256


def test_mean_copies_are_the_fraction(spark, tmp_path):
    """Over many seeds a document is taken as often as its share says, and rows of one id share no fate."""
    rows = [(i % 7, "w " * (1 + i % 5), "a" if i % 3 else "b") for i in range(60)]
    docs = table(spark, tmp_path, rows)
    runs = [mixing.mix(docs, seed=100 * k, group=8).collect() for k in range(12)]
    per = {(r.at_file, r.at_row): r.target / r.source_size for r in runs[0]}
    taken = Counter()
    for run in runs:
        for r in run:
            assert math.floor(per[r.at_file, r.at_row] + 1e-9) <= r.copies <= math.ceil(per[r.at_file, r.at_row] - 1e-9)
            taken[r.at_file, r.at_row] += r.copies
    off = [taken[k] / len(runs) - p for k, p in per.items()]
    assert abs(sum(off) / len(off)) < 0.03
    assert max(map(abs, off)) < 0.6


def slow_features(text):
    """The features written plainly, on characters instead of bytes."""
    text = text or ""
    n, words, lines = max(1, len(text)), words_(text), text.split("\n")
    share = lambda kind: sum(c in kind for c in text) / n
    shares = [share(k) for k in ("#$%&*", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "\n")]
    count = max(1, len(words))
    out = [*shares, *map(math.sqrt, shares[:3]), math.log(1 + count), n / count / 10, max(1, len(set(words))) / count, len(set(lines)) / len(lines)]
    out += [math.log(1 + count / len(lines)), float(text == ""), abs(n / count - 6) / 10]
    single, pair = Counter(), Counter()
    for w in words:
        single[crc32(w.encode()) % quality.BUCKETS] += 1
    for a, b in zip(words, words[1:], strict=False):
        pair[((crc32(a.encode()) * 0x9E3779B97F4A7C15 + crc32(b.encode()) * 0xD6E8FEB86659FD93) % (1 << 64)) >> 57] += 1
    return out + [math.sqrt(single[k] / count) for k in range(quality.BUCKETS)] + [math.sqrt(pair[k] / count) for k in range(quality.BUCKETS)]


def words_(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_features_and_cut_are_the_plain_ones(spark):
    for text in ("", "One two two!\nthree | é#", " \n ", "Ünï çödé 12.5 " * 50, "x" * 5000):
        assert np.allclose(quality.features(text.encode()), slow_features(text))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ranker, scores = quality.fit(docs, labels)
    weights = np.array(ranker.weights)
    text = {r.doc_id: r.text for r in docs.collect()}
    own = {i: float(np.float32(slow_features(t)) @ weights) for i, t in text.items()}
    assert all(math.isclose(r.score, own[r.doc_id], abs_tol=1e-4) for r in scores.collect())
    known = {r.doc_id: r.quality for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5}
    good = sorted(own[i] for i, q in known.items() if q == 1 and i in own)
    bad = sorted(own[i] for i, q in known.items() if q == 0 and i in own)
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    at = lambda values, share: values[max(0, math.ceil(share * len(values)) - 1)]
    low, high = at(good, 0.005), at(bad, 0.995)
    assert math.isclose(ranker.threshold, (low + high) / 2 if high < low else low, abs_tol=1e-4)


def test_media_round_trip(spark, tmp_path):
    rows = [*ROWS, (9, "x" * 64, "a"), (10, "x" * 65, "a"), (11, "a\0b", "a")]
    found = media.media_columns(table(spark, tmp_path, rows)).collect()
    assert len(found) == len(rows)
    want = Counter()
    for i, text, _ in rows:
        data = (text or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
        stored = media.encode(payload)
        assert media.decode(stored) == payload
        want[i, len(data), len(payload), __import__("hashlib").sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), media.feature(payload), len(payload) // 64] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.feature, r.height) for r in found) == want
    assert {(r.width, r.bits) for r in found} == {(64, 8)}
    assert media.media_columns(table(spark, tmp_path, [], "none")).count() == 0


def test_shards_are_tar_files(spark, tmp_path):
    import tarfile

    root = tmp_path / "root"
    root.mkdir()
    rows = media.store(table(spark, tmp_path, ROWS), f"file://{root}").collect()
    members = {}
    for path in root.iterdir():
        with tarfile.open(path) as tar:
            for m in tar.getmembers():
                members[path.name, m.offset_data] = (m.name, m.size, tar.extractfile(m).read())
    for r in rows:
        name, size, data = members[r.shard, r.offset]
        assert name == bytes(r.digest).hex() + ".png"
        assert size == r.length == len(data)


def slow_scores(rows, order, least, discount):
    """The same model, written plainly with dictionaries of word tuples."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for _, t, _ in rows]
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    most = least
    kept = [{(w,): k for w, k in c.items() if k >= most} | {("<s>",): len(train)}]
    for size in range(2, order + 1):
        grams = Counter()
        for t in train:
            s = ["<s>", *t]
            grams.update(tuple(s[i : i + size]) for i in range(len(s) - size + 1))
        kept.append({g: k for g, k in grams.items() if k >= most and g[:-1] in kept[-1] and g[1:] in kept[-1]})

    def p(history, word):
        if not history:
            return (c[word] + 1) / (n + v + 1)
        if history not in kept[len(history) - 1]:
            return p(history[1:], word)
        total = kept[len(history) - 1][history]
        arcs = {g: k for g, k in kept[len(history)].items() if g[:-1] == history}
        rest = min(1.0, max(1e-12, 1 - sum(k - discount for k in arcs.values()) / total))
        own = arcs.get((*history, word))
        return (max(0, own - discount) / total if own else 0) + rest * p(history[1:], word)

    out = []
    for (i, _, _), t, h in zip(rows, tokens, held, strict=True):
        s = ["<s>", *t]
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))))
    return out


@pytest.mark.parametrize(("order", "least"), [(1, 2), (2, 2), (3, 1), (3, 2), (4, 3)])
def test_language_model_matches_a_plain_one(spark, tmp_path, order, least):
    rng = np.random.default_rng(7)
    vocabulary = [f"Wort{k}" for k in range(12)] + ["é"]
    rows = [(i, " ".join(vocabulary[int(x)] for x in rng.zipf(1.5, int(rng.integers(0, 40))) % 13), "s") for i in range(90)]
    rows += [(100, "never-seen words here wort1", "s"), (None, "wort1 wort2", "s"), (3, None, "s"), (4, "", "s")]
    how = {"order": order, "least": least, "discount": 0.75}
    found = language_model.score_documents(table(spark, tmp_path, rows), chunk_bytes=300, shard_keys=200, **how).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 4))
    got, want = sorted(map(tuple, found), key=key), sorted(slow_scores(rows, **how), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], abs_tol=1e-9)
        assert math.isclose(a[6], b[6], abs_tol=1e-9)


def test_language_model_beats_its_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_model.score_documents(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_language_model_of_nothing(spark, tmp_path):
    assert language_model.score_documents(table(spark, tmp_path, [])).count() == 0


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.97
    assert good.predicted.mean() > 0.95
    assert bad.predicted.mean() < 0.2
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_edge_cases(spark, tmp_path):
    docs = table(spark, tmp_path, ROWS)
    for rows in ([], [(1, 1, 0), (None, 0, 0), (2, None, 0)], [(1, 1, 0), (3, 0, 0), (6, 1, 1), (6, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        found = quality.score_documents(docs, labels).collect()
        assert len(found) == len(ROWS)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert quality.score_documents(table(spark, tmp_path, [], "none"), labels).count() == 0


def test_large_ids_stay_whole_beside_nulls(spark, tmp_path):
    big = (1 << 62) + 1
    docs = table(spark, tmp_path, [(big, "one two three", "a"), (big + 2, "four five", "a"), (None, "six", "a")])
    for found in (mixing.mix(docs), packing.pack(docs, RANKS, PATTERN, SPECIAL), language_model.score_documents(docs), media.media_columns(docs)):
        assert {r.doc_id for r in found.select("doc_id").collect()} == {big, big + 2, None}
