"""Alignment, fingerprints and phrases against brute force, with awkward rows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import alignment, fingerprint, phrases

#: Null, empty and blank texts, repeated rows, a null id, ties, one long word, signs that tokenisers treat apart.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other"), (None, "a b c d e f"), (None, None),
           (6, "x" * 30000 + " tail "), (7, "été 日本語 \U0001f600 don't"), (8, "line;\r\n line\r line\n"), (9, "a▁b"), (10, " lead  two"),
           (11, "<|endoftext|> </s> <0x41>"), (12, "\x00 \x1c \xa0　 b"), (13, "a "), (14, "A.b,C;d:e!f?g\x0bh\x0ci\tj")]
COLUMNS = "doc_id long, text string, n_a long, kind string, row long, lang string"


@pytest.fixture()
def awkward(spark):
    return spark.createDataFrame([(i, t, 9, "z", None, None if k % 2 else "en") for k, (i, t) in enumerate(AWKWARD)], COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# --- alignment


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = bytes_of_characters()
    return a, b, table


def bytes_of_characters():
    """Byte-level characters to bytes: printable ones stand for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokens_of(text, both):
    a, b, table = both
    data = (" " + (text or "")).encode()
    if not text:
        return [], []
    coded = a.encode(" " + text, add_special_tokens=False)
    tokens_a = [(i, bytes(table[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
    tokens_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(t for _, t in tokens_a) != data or b"".join(t for _, t in tokens_b) != data:
        return [], []
    return tokens_a, tokens_b


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def aligned_by_force(texts, both):
    documents, pairs = [], Counter()
    for text in texts:
        a, b = map(spans, tokens_of(text, both))
        links, first = [], 0
        for i, start, end in a:
            while first < len(b) and b[first][2] <= start:
                first += 1
            k = first
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        pairs.update(links)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for cut in cuts:
            side = [",".join(str(i) for i, s, e in t if low <= s < cut) for t in (a, b)]
            groups.append("|".join(side))
            low = cut
        documents.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    return [(n_a, n_b, len(g), len(x), sum(pairs[p] == best[p[1]] for p in x), sum(pairs[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, x in documents]


def test_alignment_against_brute_force(spark, awkward, both, monkeypatch):
    rng = random.Random(4)
    parts = ["a", "the", "É", " ", " ", " ", "\n", "\t", "  ", "'s", "'", "1", ";\r", "　", "日", "!", "<|endoftext|>", "\xa0", "\U0001f600", "tion", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    rows = [(i, t) for i, t in AWKWARD] + [(100 + k, t) for k, t in enumerate(texts)]
    want = sorted(zip([str(i) for i, _ in rows], aligned_by_force([t for _, t in rows], both)))
    whole = frame(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((str(r["doc_id"]), tuple(r[c] for c in columns)) for r in alignment.align(whole).collect())
    assert got == want
    assert alignment.align(awkward).count() == len(AWKWARD)
    assert alignment.align(awkward.limit(0)).count() == 0


def test_chunks_and_blocks_do_not_show(both):
    """Documents in one chunk or in many, in one block or in many, long runs of one document."""
    own = alignment.tokenisers(alignment.RANKS, alignment.MODEL)
    coded = [own.encode(t) for t in ("the cat sat", "in-ter-na-tion-al " * 300, "é" * 40, "x")]
    together = alignment.Chunk(own, coded).align()
    for k, document in enumerate(coded):
        groups, digests, keys, times = alignment.Chunk(own, [document]).align()
        mine = together[2] >> 40 == k
        assert groups[0] == together[0][k] and digests[0] == together[1][k]
        assert list(keys) == list(together[2][mine] & (1 << 40) - 1) and list(times) == list(together[3][mine])


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 200), min_size=1), st.sets(st.integers(1, 200), min_size=1), st.integers(1, 9), st.integers(1, 4))
def test_merge_path_is_the_merge(a, b, piece, at_once):
    end = max(a | b)
    a, b = np.array(sorted(a | {end})), np.array(sorted(b | {end}))
    made = [np.concatenate(x) for x in zip(*alignment.merged(a, b, piece, at_once))]
    ends = np.union1d(a, b)
    assert list(made[0]) == list(np.searchsorted(a, ends)) and list(made[1]) == list(np.searchsorted(b, ends))
    common = np.intersect1d(a, b)
    assert list(made[2]) == list(np.searchsorted(a, common) + 1) and list(made[3]) == list(np.searchsorted(b, common) + 1)
    cuts = alignment.diagonals(a, b, piece)
    assert (np.diff(cuts[0] + cuts[1])[:-1] == piece).all()


# --- fingerprints


def digest_by_force(data):
    counts = Counter()
    for kind, (p, q, r) in enumerate(fingerprint.PLACES):
        for i in range(len(data) - r):
            x = (data[i + p] << 16) + (data[i + q] << 8) + data[i + r] + (kind << 24)
            counts[(x * fingerprint.MULTIPLIER % (1 << 32)) >> 23] += 1
    all_counts = [counts[k] for k in range(512)]
    ordered = sorted(all_counts)
    codes = [sum(n > ordered[128 * k - 1] for k in (1, 2, 3)) for n in all_counts]
    length = 0
    if data:
        octave = len(data).bit_length() - 1
        length = 64 * octave + (64 * len(data) >> octave)
    body = "".join(f"{codes[k] * 64 + codes[k + 1] * 16 + codes[k + 2] * 4 + codes[k + 3]:02x}" for k in range(0, 512, 4))
    return f"{length:04x}{body}", codes, length


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_against_brute_force(spark, awkward, parts):
    frames = awkward.repartition(parts) if parts > 1 else awkward.coalesce(1)
    got = fingerprint.with_next(frames).collect()
    assert len(got) == len(AWKWARD)
    # rows that repeat an id are ordered by a hash; ids that do not repeat have a defined neighbour
    single = [(i, t or "") for i, t in AWKWARD if i is not None and i > 4]
    order = sorted(single, reverse=True)
    by_id = {r["doc_id"]: r for r in got}
    for (i, text), (_, following) in zip(order, order[1:]):
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        own, next_own, new = map(digest_by_force, (text.encode(), following.encode(), changed.encode()))
        near = lambda x, y: max(0, 2560 - 3 * sum(abs(p - q) for p, q in zip(x[1], y[1])) - 10 * min(64, abs(x[2] - y[2]))) / 2560
        row = by_id[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (row["fingerprint"], row["edited_fingerprint"]) == (own[0], new[0])
        assert (row["near_edited"], row["near_next"]) == (near(own, new), near(own, next_own))
    equal = {r["fingerprint"] for r in got if r["n_chars"] == len("a b c d e f") and r["doc_id"] in (None, 4)}
    assert len(equal) == 1


def test_fingerprint_order_wraps(spark):
    rows = [(1, "first text here", "en"), (2, "second one", "en"), (3, "the third", "en")]
    got = {r["doc_id"]: r for r in fingerprint.with_next(frame(spark, rows).repartition(3)).collect()}
    changed = "first text" + "the t"
    assert got[1]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    alone = fingerprint.with_next(frame(spark, rows[:1])).collect()[0]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"first text" + b"first").hexdigest()
    assert fingerprint.with_next(frame(spark, rows).limit(0)).count() == 0


def test_long_text_is_counted_in_slices(monkeypatch):
    data = random.Random(2).randbytes(5000)
    want = digest_by_force(data)[0]
    for size in (7, 64, 4999, 5000):
        monkeypatch.setattr(fingerprint, "SLICE", size)
        assert fingerprint.digest(data) == want
    assert fingerprint.likeness(want, want) == 1.0


# --- phrases


def phrases_by_force(rows, least, percent, longest=4):
    import re
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        inside = [b for (other, longer), b in found.items() if other == lang and len(longer) > len(words)
                  and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
        dropped = any(100 * b >= percent * a for b in inside)
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score, dropped))
    return sorted(out)


def spoken(n, seed):
    rng = random.Random(seed)
    words = ["of", "the", "new", "york", "city", "a", "é", "Of", "b\x00", "new york", "in the city of", "of the"]
    return [(rng.choice(["en", "en", "en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("longest, shares, held", [(4, 4096, 1_500_000), (4, 3, 50), (3, 40, 400), (2, 4096, 50)])
def test_phrases_against_brute_force(spark, monkeypatch, longest, shares, held):
    """Also with split stripes and tasks that emit early."""
    monkeypatch.setattr(phrases, "SHARES", shares)
    monkeypatch.setattr(phrases, "COUNTERS_HELD", held)
    monkeypatch.setattr(phrases, "BUNDLE", 3 if held < 1000 else 256)
    monkeypatch.setattr(phrases, "MERGED", held)
    rows = spoken(300, longest) + [(None, None), ("en", ""), ("fr", ".,;")]
    docs = spark.createDataFrame([(l, t, 1, "x") for l, t in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, longest=longest, least=8).select("lang", "phrase", "a", "l", "r", "n", "score", "dropped").collect())
    assert got == phrases_by_force(rows, 8, 80, longest)
    assert any(r[-1] for r in got) or longest == 2


def test_ranked_phrases(spark, awkward):
    docs = spark.createDataFrame(spoken(300, 9), "lang string, text string")
    found = phrases.collocations(docs, least=5)
    want = Counter()
    rows = sorted((r for r in found.collect() if not r["dropped"]), key=lambda r: (r["lang"], -r["score"], -r["a"], r["phrase"].encode()))
    expected = []
    for r in rows:
        want[r["lang"]] += 1
        if want[r["lang"]] <= 7:
            expected.append((r["lang"], want[r["lang"]], r["phrase"]))
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in phrases.ranked(found, 7).collect()) == expected
    assert phrases.collocations(awkward).count() == 0
    assert phrases.collocations(awkward.limit(0)).count() == 0
    assert phrases.collocations(awkward, least=1).where("a < 1").count() == 0


def test_a_stripe_may_span_batches(spark):
    """One hot pair in many rows and parts: merged once, counted whole."""
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    docs = spark.range(3000).selectExpr("'en' as lang", "concat('hot pair w', id % 7) as text").repartition(40)
    found = {r["phrase"]: r["a"] for r in phrases.collocations(docs).collect()}
    assert found["hot pair"] == 3000 and sum(n for p, n in found.items() if p.startswith("hot pair ")) == 3000
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_alignment_query_over_a_table(spark, both):
    from tidemark.llm import common, queries

    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], aligned_by_force([r["text"] for r in docs], both)))
    got = queries.QUERIES["op11_merge_path_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
