"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import alignment, divergence, token_counts
from tallyforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string"
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", None, "a", "▁", "x▁y", "a\x00b", "<s> </s><unk> <|endoftext|> <0x0A>", "\n\n\t x", "é́ ﬁ ① 日本語テキスト 𝔘𝔫𝔦", " " * 3000 + "x", "ab" * 4000, "日本" * 3000, "①" * 2500, "end\r\n"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(seed: int, n: int) -> list[str]:
    """Long texts of words, runs of one character, letters beyond the model and no spaces at all."""
    r = random.Random(seed)
    kinds = [lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + " ", lambda: r.choice(" a=-\n①") * r.randint(1, 90), lambda: "".join(chr(r.choice([r.randint(0x4E00, 0x4E80), r.randint(0x1F600, 0x1F640), r.randint(32, 126)])) for _ in range(20)), lambda: "▁" * r.randint(1, 3)]
    return ["".join(r.choice(kinds)() for _ in range(r.randint(50, 400))) for _ in range(n)]


def docs(spark, texts, langs=("en",), sources=("s",)):
    return spark.createDataFrame([(k, t, langs[k % len(langs)], sources[k % len(sources)]) for k, t in enumerate(texts)], DOC)


# Token counts (13)


@pytest.mark.parametrize("chunk, overlap", [(40, 16), (257, 64), (32_768, 512)])
def test_counts_are_those_of_whole_texts(spark, model, chunk, overlap):
    texts = ODD + odd_texts(chunk, 30)
    found = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), MODEL, 100, chunk, overlap).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len((t or "").encode()), n, n > 100), k


def test_counts_of_repeated_null_and_clashing_columns(spark):
    rows = [(None, "a b" * 60, 1), (None, "a b" * 60, 1), (7, None, 2), (7, "a b" * 60, 3)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").withColumnRenamed("n_tokens", "chunk")
    found = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(table, MODEL, 9, 50, 20).collect())
    n = len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("a b" * 60))
    assert found == [("7", 0), ("7", n), ("None", n), ("None", n)]
    assert token_counts.count_tokens(table.limit(0), MODEL).collect() == []


def test_counts_of_the_given_table(spark, model):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, SF).collect()}
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found == {k: (len(t.encode()), n := len(model.encode(t)), n > 4096) for k, t in given.items()}


# Alignment (12)


def plain_alignment(texts: dict[int, str | None], model) -> dict[int, tuple]:
    """From the library's own offsets and all pairs of a text's tokens that overlap."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    spans, links = {}, {}
    for k, text in texts.items():
        if not text:
            continue
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ranges = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i, p in zip(ids, parts, strict=True):
                own.append((i, at, at + len(p)))
                at += len(p)
            ranges.append(own)
        ends = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, f in own if s >= last and f <= e) for own in ranges))
            last = e
        spans[k] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        links[k] = [(x, y) for x, s, e in ranges[0] for y, t, f in ranges[1] if s < f and t < e]
    count = Counter(p for own in links.values() for p in own)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = {}
    for k in texts:
        if k in spans:
            n_a, n_b, n_groups, sha = spans[k]
            out[k] = (n_a, n_b, n_groups, len(links[k]), sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), sha)
        else:
            out[k] = (0, 0, 0, 0, 0, 0, "")
    return out


def alignments(found) -> dict[int, tuple]:
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()}


@pytest.mark.parametrize("links", [300, 2_000_000])
def test_alignment_of_odd_texts(spark, model, links):
    texts = [t if t is None else t[:900] for t in ODD + odd_texts(5, 12)] + ["the same text", "the same text"]
    found = alignments(alignment.align_documents(docs(spark, texts), RANKS, public_tokenizers.PATTERN, MODEL, links))
    assert found == plain_alignment(dict(enumerate(texts)), model)


def test_alignment_of_the_given_table(spark, model):
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")
    assert alignments(alignment.align_documents(table, RANKS, public_tokenizers.PATTERN, MODEL)) == plain_alignment(given, model)


def test_alignment_without_tokens(spark):
    none = alignment.align_documents(docs(spark, [None, "", "▁x"]), RANKS, public_tokenizers.PATTERN, MODEL)
    assert alignments(none) == dict.fromkeys(range(3), (0, 0, 0, 0, 0, 0, ""))
    assert alignment.align_documents(docs(spark, []), RANKS, public_tokenizers.PATTERN, MODEL).collect() == []


# Divergence (11)


def plain_divergence(rows: list[tuple], least: int, top: int) -> set[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = [(lang or "", source or "", [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {p[0] for p in parts}:
        own = [(s, t) for x, s, t in parts if x == lang]
        having = Counter(t for _, terms in own for t in set(terms))
        kept = sorted(t for t, n in having.items() if n >= least)
        count = {s: Counter(t for x, terms in own if x == s for t in terms if having[t] >= least) for s in {s for s, _ in own}}
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        every = sum(count.values(), Counter())
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + len(kept)) for t in kept}
        for s in share:
            pairs = [(-sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o.encode(), o) for o in share if o != s]
            terms = [(-((share[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and share[s][t] > q[t]]
            out |= {(lang, s, part, name, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, name) in enumerate(sorted(found)) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("terms, load, held", [(7, 1, 20), (50_000, 64 << 20, 400_000)])
def test_divergence_equals_a_plain_version(spark, terms, load, held):
    r = random.Random(3)
    words = ["the", "The", "THE", "été", "Été", "word", "words", "wor", "日本", "日本語", "x", "xx", "𝔘", "ß", "İ", "z" * 400]
    texts = [None, "", "12 34 !!"] + [" ".join(r.choices(words, weights=range(1, 17), k=r.randint(0, 60))) + r.choice(["", "-one_two", "9 Q"]) for _ in range(80)]
    rows = [(k % 50, t, r.choice(["en", "de", None]), r.choice(["a", "b", "", None, "ü"])) for k, t in enumerate(texts)] + [(1, "lonely words", "fr", "a"), (2, None, "fr", "b")]
    found = divergence.source_divergence(spark.createDataFrame(rows, DOC).withColumn("n", divergence.F.lit("clash")), 3, 4, terms, load, held).collect()
    assert len(found) == len({tuple(x) for x in found})
    assert {(x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in found} == plain_divergence(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOC)).collect() == []


def test_transducer_numbers_terms_and_is_minimal():
    r = random.Random(8)
    terms = sorted({"".join(r.choice("abé日") for _ in range(r.randint(1, 7))) for _ in range(600)} | {"𝔘", "z" * 300})
    made = divergence.Transducer.loaded(divergence.Transducer.of(terms).saved())
    assert made.ordinals(terms).tolist() == list(range(len(terms)))
    others = [t + "b" for t in terms] + [t[:-1] for t in terms]
    assert made.ordinals(others).tolist() == [terms.index(t) if t in set(terms) else -1 for t in others]
    # As many states as there are different sets of endings.
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in {t[:k] for t in terms for k in range(len(t) + 1)}}
    assert len(made.final) == len(endings)
    assert divergence.Transducer.of(["a"]).ordinals([]).tolist() == []


def test_shares_of_large_counts_are_exact():
    import numpy as np

    n = np.array([0, 5, 10**12], np.int64)
    assert divergence.shares(n, 2 * 10**12).tolist() == [1 + 10**9 * (int(c) + 1) // (2 * 10**12) for c in n]


def test_divergence_matches_sql(spark):
    import duckdb

    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op11_source_divergence']})").fetchall()
    found = QUERIES["op11_source_divergence"](spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(want) == sorted(map(tuple, found))


def test_spelt_bytes_are_compared_in_parts(monkeypatch):
    """Ids spell a text if their bytes are all of it, however many are put together at once."""
    both = alignment.aligner(RANKS, public_tokenizers.PATTERN, MODEL)
    text = "Ein Preis von 3.50 \U0001f600 für zwei\n\nZeilen\0 " * 9
    ids = both.b.model.encode(text, return_type="numpy")
    whole = b"".join(both.bytes_b[i] for i in ids)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(alignment, "SPELT", size)
        assert both.spells(ids, whole)
        assert not both.spells(ids, whole + b" ") and not both.spells(ids, whole[:-1]) and not both.spells(ids, b"x" + whole[1:])
