"""The dealt operators against brute force, round trips and held-out labels, with awkward rows."""

import base64
import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, common, exact_dedup, jaccard, langid, license_scan, line_dedup, packing, quality, queries, tokens, warc

TABLES = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
BLANKS = re.compile("[\x20\x09-\x0d]+")
#: Rows that every text operator must stand: null, empty and blank texts, repeated rows, a null id, one very long text.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a  b\tc d e f"), (None, "a b c d e f"),
           (6, "x" * 70000 + " tail"), (7, "été 日本語 \U0001f600 don't"), (8, "line\nline\nline\nline")]


@pytest.fixture()
def awkward(spark):
    """The awkward rows, with extra columns named as the operators' own."""
    rows = [(i, t, 1, "z", None) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, score string, ids string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ranks(path):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b", "É", " ", "\n", "\t", "  ", "'s", "'", "1", "　", "\x1c", "\x85", "日", "!", "<|endoftext|>", "\xa0", "\U0001f600", "▁"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_pieces_join_to_the_text():
    for text in odd_texts(2000):
        pieces, words = tokens.cut(text)
        assert "".join(pieces) + "".join(" " + w for w in words) == text


def test_bpe_equals_the_rank_encoder():
    own = bpe.codec(bpe.MULTI, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(bpe.MULTI), special_tokens={})
    for text in [*odd_texts(3000), "a" * 20000, " " * 5000 + "b", *(t for _, t in AWKWARD if t)]:
        ids = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_forgets_and_goes_on():
    own = bpe.Codec(bpe.MULTI, public_tokenizers.PATTERN)
    known = tokens.Known(own._ids_of, limit=5)
    for text in odd_texts(200):
        assert known.encode(text) == own.encode(text)


def test_bpe_rows(spark, awkward):
    got = bpe.round_trip(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((i, (t or "").encode()) for i, t in AWKWARD)
    assert bpe.round_trip(awkward.limit(0)).count() == 0


def brute_components(rows, size, percent):
    sets, up = [], list(range(len(rows)))
    for _, text in rows:
        words = [w for w in BLANKS.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append(frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset())

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[top(x)].append(rows[x][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[x][0]), len(sets[x]), str(least[top(x)])) for x in range(len(rows)))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, size, percent):
    """A hot group of near copies around one text that comes last, chains of edits, a shared passage, short texts."""
    rng = random.Random(percent)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(40)], []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = word()
        rows.append((1000 - i, " ".join(text)))
    chain = [word() for _ in range(90)]
    for i in range(30):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = word()
        rows.append((2000 + i, " ".join(chain).upper()))
    rows += [(3000 + i, " ".join([word() for _ in range(rng.randint(0, 60))] + passage)) for i in range(60)]
    rows += [(4000 + i, " ".join(rng.choices("ab", k=rng.randint(0, 12)))) for i in range(60)]
    rows += AWKWARD + [(4, "another text under the same id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = jaccard.linked(docs, size=size, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, size, percent)


def test_jaccard_keeps_one_of_each_group(spark, awkward):
    kept = jaccard.kept_rows(awkward)
    assert kept.columns == awkward.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "6", "7", "8"]
    assert jaccard.kept_rows(awkward.limit(0)).count() == 0


def test_kept_steps_give_the_driver_heap_back(spark, monkeypatch):
    """A kept step has a grown heap collected as a whole; one that has not grown since is left alone, and so is a small one."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName())
    scratch = common.Scratch(spark, "heap")
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0, raising=False)
    monkeypatch.setattr(common, "_heap_left", [0.0], raising=False)
    before = whole()
    assert scratch.keep(spark.range(3), "ids").count() == 3
    assert whole() == before + 1
    monkeypatch.setattr(common, "HEAP_GROWTH", 100)
    scratch.keep(spark.range(3), "not-grown")
    monkeypatch.setattr(common, "HEAP_SHARE", 1.1)
    monkeypatch.setattr(common, "_heap_left", [0.0])
    scratch.keep(spark.range(3), "small")
    assert whole() == before + 1
    scratch.drop()


def test_jaccard_compares_sets_part_by_part(spark, monkeypatch):
    """No write of a comparison reads more than one part of the sets, so no whole set is shuffled with a pair."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(base[: 300 - 2 * i] + [f"x{i}y{j}" for j in range(2 * i)])) for i in range(30)] + [(50 + i, f"alone {i} " * 40) for i in range(5)]
    steps, keep = [], common.Scratch.keep

    def seen(self, df, name, *more):
        if name.startswith("links"):
            steps.append(set(re.findall("shingles_[0-9]+", df._jdf.queryExecution().executedPlan().toString())))
        return keep(self, df, name, *more)

    monkeypatch.setattr(common.Scratch, "keep", seen)
    got = jaccard.linked(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 5, 80)
    assert steps and all(len(parts) == 1 for parts in steps)
    assert set.union(*steps) == {f"shingles_{g}" for g in range(jaccard.SET_PASSES)}


def test_jaccard_makes_sets_of_likely_pairs_only(spark, monkeypatch):
    """Long texts that share half their words meet in blocks, but sketches rule them out: only the two near copies are cut into sets."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(750)
    rows = [(i, passage + words(750)) for i in range(12)]
    rows.append((20, rows[3][1][:-5] + words(5)))
    rows = [(i, " ".join(text)) for i, text in rows]
    nodes, members, keep = set(), [], common.Scratch.keep

    def seen(self, df, name, *more):
        kept = keep(self, df, name, *more)
        if "shingles_0" in kept.columns:
            nodes.update(r.node for r in kept.select("node").collect())
        if name == "members":
            members.append(kept.count())
        return kept

    monkeypatch.setattr(common.Scratch, "keep", seen)
    got = jaccard.linked(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 5, 80)
    assert members == [13] and len(nodes) == 2


def test_wide_sketches_bound_the_difference(spark):
    """Also of sets whose sketches differ in length: folded if by half, else not judged."""
    rng, rows, apart = np.random.default_rng(3), [], []
    for n, other in [(40, 45), (512, 513), (500, 600), (1000, 1100), (1000, 1030), (2048, 2049), (5000, 5100), (900, 2500), (600, 0), (9000, 700)]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(0, min(n, other) - 30)], rng.integers(0, 2**63, min(30, other), dtype=np.uint64)]))
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, max(0, other - len(b)), dtype=np.uint64)]))
        rows.append((len(apart), *(jaccard.wide_sketch(x).tolist() for x in (a, b))))
        apart.append(len(np.setxor1d(a, b)))
    found = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    found = {r.i: r.d for r in found.select("i", jaccard._apart(found.a, found.b).alias("d")).collect()}
    assert all(0 <= found[i] <= apart[i] for i in range(len(rows)))
    assert found[0] == found[1] == found[8] == found[9] == 0
    assert all(found[i] > 0.5 * min(apart[i], 512) for i in (3, 4, 5, 6))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]))
        if not len(b):
            continue
        different = len(np.setxor1d(a, b))
        distance = sum(int(x).bit_count() for x in (jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view(np.uint64))
        assert distance <= different
        for percent in (80, 90):
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and different:
                assert set(jaccard.block_keys(a, percent).tolist()) & set(jaccard.block_keys(b, percent).tolist())


def exact_nearest(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in good if i != q)
            out[q] = scores[:k]
    return out


def test_search_with_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(200)]
    hot = rows[40][1]
    rows += [(i, hot) for i in range(1000, 1060)]  # one vector many times, some of them queries
    rows += [(300, None), (320, [0.0] * 8), (340, [1.0] * 7 + [None]), (360, [1.0] * 7 + [float("nan")]), (380, [float("inf")] * 8), (400, []), (420, [1.0] * 3), (None, hot), rows[3]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    want = exact_nearest(rows, 20)
    assert set(got) == set(want)
    for q, found in got.items():  # so few vectors are one part: the search is exact
        assert [v for v, _, _ in found] == [i for _, i in want[q]] and [r for _, _, r in found] == list(range(1, 21))
        assert np.allclose([s for _, s, _ in found], [-s for s, _ in want[q]], rtol=0, atol=1e-12)
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_learned_parts_reach_their_recall():
    """Clustered vectors: parts are balanced, few are visited, and most neighbours are found."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.fit(x[:2500], 20)
    part, parts = model.logits(x).argmax(axis=1), model.w2.shape[1]
    balanced = ann.balanced_parts(x[:2500], ann.nearest_in(x[:2500], 16), parts)
    assert parts == 16 and np.bincount(balanced, minlength=parts).max() <= 1.06 * 2500 / parts
    visited = np.argsort(-model.logits(x[2500:]), axis=1)[:, : model.visits]
    near = ann.nearest_in(x, 20)[2500:]
    recall = np.mean([np.isin(part[n], v).mean() for n, v in zip(near, visited)])
    assert model.visits <= parts // 2 and recall >= 0.9


def test_visits_follow_from_vectors_outside_training(monkeypatch):
    """Nothing that sets the number of visits was seen by graph, parts or classifier."""
    x, seen, graphs = np.random.default_rng(9).standard_normal((1024, 8)), [], []
    cut, train = ann.balanced_parts, ann._trained
    monkeypatch.setattr(ann, "balanced_parts", lambda vectors, graph, parts: graphs.append(vectors) or cut(vectors, graph, parts))
    monkeypatch.setattr(ann, "_trained", lambda vectors, soft: seen.append(vectors) or train(vectors, soft))
    model = ann.fit(x, 20)
    inside = {tuple(v) for v in seen[0]}
    assert {tuple(v) for v in graphs[0]} == inside and len(inside) == 896
    new = np.array([tuple(v) not in inside for v in x])
    near, part = ann.nearest_in(x, 20)[new], model.logits(x).argmax(axis=1)

    def covered(visits):
        visited = np.argsort(-model.logits(x[new]), axis=1)[:, :visits]
        return np.concatenate([np.isin(part[n[new[n]]], v) for n, v in zip(near, visited)]).mean()

    assert covered(model.visits) >= ann.COVERAGE and (model.visits == 1 or covered(model.visits - 1) < ann.COVERAGE)


def test_search_goes_on_until_there_are_enough_candidates(spark, monkeypatch):
    """With parts that hold fewer than k + 1 candidates, k are found all the same."""
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda sample, k: fit(sample, k)._replace(visits=1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(7).standard_normal((600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (200, 599, 700):
        got = Counter(r.query_id for r in ann.search(df, F.col("vec_id") % 100 == 0, k=k).collect())
        assert got == {q: min(k, 599) for q in range(0, 600, 100)}


@tables
def test_search_recall_outside_the_sample(spark, monkeypatch):
    """The given vectors with half of them outside the sample: nine tenths of the neighbours are found, and of those outside."""
    monkeypatch.setattr(ann, "SAMPLE", 1024)
    vectors = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    drawn, fit = set(), ann.fit
    monkeypatch.setattr(ann, "fit", lambda sample, k: drawn.update(map(tuple, sample)) or fit(sample, k))
    got = defaultdict(set)
    for r in queries.op3_learned_partitions(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    assert len(drawn) < 1200
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    outside, found, found_outside = np.array([tuple(v) not in drawn for v in x]), [], []
    for q in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, -(x @ x[q])))
        near = order[order != q][:20]
        hit = np.isin(ids[near], list(got[int(ids[q])]))
        found.append(hit)
        found_outside.append(hit[outside[near]])
    print("recall", np.mean(found), "outside", np.concatenate(found_outside).mean())
    assert np.mean(found) >= 0.9 and np.concatenate(found_outside).mean() >= 0.9


@tables
def test_search_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in common.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = defaultdict(set)
    for r in queries.op3_learned_partitions(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    found = []
    for q in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, -(x @ x[q])))
        found.append(len(got[int(ids[q])] & set(ids[order[order != q][:20]].tolist())) / 20)
    assert np.mean(found) >= 0.9


@tables
def test_quality_on_held_out_labels(spark):
    scored = queries.op4_quality_votes(spark, TABLES).join(common.table(spark, TABLES, "labels"), "doc_id").where("held_out").toPandas()
    assert len(scored) > 50 and scored.score.between(0, 1).all()
    assert ((scored.predicted == 1) == (scored.quality == 1)).mean() > 0.9
    assert (scored.predicted[scored.quality == 1] == 1).mean() > 0.97


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, 1), (8, None), (9, 5), (None, 1), (4, 1)], "doc_id long, quality int")
    scored = quality.score(awkward, quality.fit(awkward, labels))
    assert scored.columns == awkward.columns and scored.count() == len(AWKWARD)
    by_id = {r.doc_id: r.score for r in scored.collect()}
    assert by_id[1] == by_id[2] == pytest.approx(2 / 3) and by_id[7] < 0.5 < by_id[4]
    none = quality.score(awkward, quality.fit(awkward, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.score(awkward.limit(0), quality.fit(awkward.limit(0), labels)).count() == 0


@tables
def test_languages_on_held_out_rows(spark):
    judged = queries.op7_language_centroids(spark, TABLES).join(common.table(spark, TABLES, "documents", "doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(judged) > 100 and (judged.lang_pred == judged.lang).mean() > 0.98 and judged.rejected.mean() < 0.02


def test_language_of_awkward_rows(spark, awkward):
    german, french = "der hund und die katze sind nicht hier ", "le chien et la chatte ne sont pas ici "
    train = spark.createDataFrame([(i, german * (i % 3 + 1), "de") for i in range(20)] + [(i, french * (i % 3 + 1), "fr") for i in range(20, 40)]
                                  + [(50, None, "de"), (51, german, None), (None, german, "fr"), (0, german, "de")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "fr"]
    mixed = awkward.unionByName(frame(spark, [(20, "die katze"), (21, "la chatte"), (22, "12 34 !!"), (23, "qqq zzz xxx jjj")]), allowMissingColumns=True)
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert (got[20].lang_pred, got[21].lang_pred) == ("de", "fr")
    for i in (1, 2, 3, 22):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[23].rejected and not got[20].rejected
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(awkward, empty).collect()} == {"und"}


def check_packed(rows, documents):
    """Every id in exactly one piece, sequences without gaps, within the window, all of them full or powers of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 4 > 0
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048 and end & (end - 1) == 0
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    for i, text in documents:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        copies = len([d for d in documents if d[0] == i])
        assert sum(r.length for r in pieces) == copies * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        if copies == 1:
            joined = b"".join(bytes(r.ids) for r in pieces)
            assert list(struct.unpack(f"<{len(joined) // 4}I", joined)) == ids


def test_packing_rows(spark, awkward):
    check_packed(packing.pack(awkward).collect(), AWKWARD)
    assert packing.pack(awkward.limit(0)).count() == 0


def test_packing_tokenises_as_the_library_at_its_defaults(spark):
    """Also where a text holds the added token, beside blanks and other white space, repeated or cut short."""
    mark, encoder = "<|endoftext|>", tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    around = ["", " ", "  ", "\n", " \n ", "\t", "\xa0", "a", " a", "a ", "'s", "!", mark]
    texts = [left + mark + right for left in around for right in around]
    texts += [f"so{t}on and {t} so {t}" for t in texts] + ["<|endoftext|", "<|endo ftext|>", "<|ENDOFTEXT|>", f"<|{mark}|>", *odd_texts(2000)]
    want = {i: [*encoder.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert any(50256 in ids for ids in want.values())
    own = packing.tokens_of(packing.RANKS, packing.VOCABULARY)
    assert all(list(memoryview(own.encode(t)).cast("I")) == want[i][:-1] for i, t in enumerate(texts))
    got = defaultdict(list)
    for r in packing.pack(frame(spark, list(enumerate(texts)))).orderBy("start").collect():
        got[r.doc_id] += memoryview(bytes(r.ids)).cast("I")
    assert got == want


@tables
def test_packing_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    rows = packing.pack(docs).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op5_sum_of_squares_packing(spark, "/root/testdata/sf0.001").collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}


def test_levels_minimise_the_sum_of_squares():
    rng, levels = random.Random(3), packing.LevelArray(16)
    for n in range(400):
        size, counts = rng.randint(1, 15), levels.counts.copy()

        def after(level):
            own = counts.copy()
            own[level] -= level > 0
            own[level + size] += level + size < 16
            return int((own[1:16] ** 2).sum())

        options = [0, *[h for h in range(1, 17 - size) if counts[h]]]
        assert after(levels.choose(size)) == min(map(after, options))
        levels.put(packing.Piece(n, 0, bytes(4 * size), size))
        assert levels.open == levels.counts.sum() == sum(map(len, levels.windows))


def test_settling_loses_nothing():
    rng = random.Random(8)
    documents = [(n, struct.pack(f"<{k}I", *[rng.randrange(9) for _ in range(k)])) for n, k in enumerate(rng.choices([0, 1, 5, 9, 15, 16, 17, 40], k=300))]
    for most in (3, 1000):
        parts = defaultdict(dict)
        for content in packing.sequences(iter(documents), 16, most):
            total = sum(map(len, content))
            assert total == 16 or total & (total - 1) == 0
            for piece in content:
                parts[piece.doc][piece.start] = piece.ids
        assert all(b"".join(parts[n][s] for s in sorted(parts[n])) == ids for n, ids in documents)


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c\r\nX: y", "other é"), (5, None, None), (4, "http://d", ""), (None, "http://e", "same"), (1, "http://b", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    folder = str(tmp_path / "archive")
    warc.write_archive(df, folder)
    got = warc.reconstruct(spark, folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(3, "same", "revisit", 1), (1, "same", "response", None), (1, "same", "response", None), (None, "same", "revisit", 1), (2, "other é", "response", None), (4, "", "response", None), (5, "", "revisit", 4)]
    assert sorted(map(str, ((r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    for r in got:
        assert (r.n, r.digest) == (len(bytes(r.payload)), digest(bytes(r.payload).decode()))
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert int(re.search(rb"^Content-Length: (\d+)", head, re.M)[1]) == len(block) - 4 and block.endswith(b"\r\n\r\n")
        assert block.partition(b"\r\n\r\n")[2][:-4] == (bytes(r.payload) if r.record_type == "response" else b"")
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    small = str(tmp_path / "small")
    warc.write_archive(df, small, least_bytes=5)
    kinds = Counter((r.page_id, r.record_type) for r in warc.inventory(spark, small).collect())
    assert kinds == Counter((p[0], "response") for p in pages)
    warc.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.reconstruct(spark, str(tmp_path / "none")).count() == 0
    wrong = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"forged"))
    wrong.write.parquet(str(tmp_path / "forged/payloads"))
    spark.read.parquet(f"{folder}/records").write.parquet(str(tmp_path / "forged/records"))
    with pytest.raises(Exception, match="differs from its address"):
        warc.inventory(spark, str(tmp_path / "forged")).collect()


@pytest.mark.parametrize("kind", ["response", "revisit"])
def test_archive_query_puts_every_record_together(spark, tmp_path, monkeypatch, kind):
    """A record whose block is not as long as its header says fails the registered query."""
    spark.createDataFrame([(1, "http://a", "same é"), (2, "http://b", "same é"), (3, "http://c", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    query, write = queries.op6_warc_archive, warc.write_archive
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in query(spark, str(tmp_path)).orderBy("page_id").collect()] == [
        (1, 7, "response"), (2, 7, "revisit"), (3, 0, "response")]

    def write_wrong(pages, folder):
        write(pages, f"{folder}/right")
        spark.read.parquet(f"{folder}/right/payloads").write.parquet(f"{folder}/payloads")
        head = F.col("head").cast("string")
        wrong = F.when(F.contains(head, F.lit(f"WARC-Type: {kind}")), F.regexp_replace(head, "^((?s).*?)\r\nContent-Length: ", "$1\r\nContent-Length: 1")).otherwise(head)
        spark.read.parquet(f"{folder}/right/records").withColumn("head", wrong.cast("binary")).write.parquet(f"{folder}/records")

    monkeypatch.setattr(warc, "write_archive", write_wrong)
    with pytest.raises(Exception, match="not as long as its Content-Length"):
        query(spark, str(tmp_path)).collect()


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[BLANKS.sub(" ", text or "")].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(map(str, ((i, least[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)))


@pytest.mark.parametrize("moduli,chunk", [(exact_dedup.MODULI, exact_dedup.CHUNK), ((2, 3), 7)])
def test_exact_groups(spark, awkward, moduli, chunk):
    """Also with fingerprints that collide all the time, and chunks of a few bytes."""
    rng = random.Random(1)
    rows = [*AWKWARD, *[(100 + i, rng.choice(["ab", "ba", "a b", "a\t b ", " a b", "abc" * 9, "hot\n\ntext"])) for i in range(80)]]
    docs = awkward.unionByName(frame(spark, rows[len(AWKWARD):]), allowMissingColumns=True)
    got = exact_dedup.groups_of(docs, moduli=moduli, chunk=chunk).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == brute_groups(rows)
    assert len([r for r in got if r.kept]) == len({BLANKS.sub(" ", t or "") for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_fingerprints_compose():
    data, p, b = b"some longer text " * 50, exact_dedup.MODULI[0], exact_dedup.BASES[0]
    whole = exact_dedup.chunk_hashes(data, chunk=1 << 16)[0][0]
    folded = 0
    for h, _, shift, _ in exact_dedup.chunk_hashes(data, chunk=7):
        folded = (folded * shift + h) % p
    assert folded == whole == sum(c * pow(b, len(data) - 1 - i, p) for i, c in enumerate(data)) % p


def test_exact_keeps_whole_rows(spark, awkward):
    kept = exact_dedup.kept_rows(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "8"]
    assert exact_dedup.kept_rows(awkward.limit(0)).count() == 0


def test_license_scan_of_awkward_rows(spark, awkward):
    filler = "wort " * 90
    more = [(20, f"{filler}Released under\nthe MIT-License {filler}"), (21, "released MIT under license"), (22, f"mit {filler} license {filler} released {filler} under the"),
            (23, "CC BY, cc-by CC BYE; all rights reserved"), (24, "GENERAL Kublic PUBLIC LICENSE general public license"), (25, "©all rights reserved")]
    got = {r.doc_id: r for r in license_scan.scan(awkward.unionByName(frame(spark, more), allowMissingColumns=True)).collect()}
    assert (got[20].labels, got[20].n_base, got[20].score, got[20].first_word) == ("mit", 0, 1.0, None) and got[20].n_words == 185
    assert (got[21].labels, got[21].score) == ("mit", 0.8) and (got[22].labels, got[22].score) == ("", 0.0)
    assert (got[23].n_base, got[23].first_word, got[23].last_word, got[23].base_labels) == (3, 0, 6, "cc-by,reserved")
    assert (got[24].n_base, got[24].first_word, got[24].n_words) == (1, 4, 7) and got[25].n_base == 0
    for i in (1, 2, 3):
        assert (got[i].n_words, got[i].labels, got[i].score) == (0, "", 0.0)
    assert license_scan.scan(awkward).count() == len(AWKWARD) and license_scan.scan(awkward.limit(0)).count() == 0


def brute_lines(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines, gone = (text.split("\n") if text is not None else []), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone) if text is not None else None
        out.append((i, kept, len(lines), len(gone)))
    return sorted(map(str, out))


def test_line_dedup_against_brute_force(spark, awkward):
    rng = random.Random(11)
    rows = [*AWKWARD, *[(100 + i, "\n".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 8, 40])))) for i in range(40)]]
    docs = awkward.unionByName(frame(spark, rows[len(AWKWARD):]), allowMissingColumns=True)
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got))) == brute_lines(rows)
    before, after = ({x for _, t in rows if t is not None for x in t.split("\n")}, {x for r in got if r.text is not None for x in r.text.split("\n")})
    assert before == after  # every distinct line is still somewhere
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark, awkward):
    for df in (license_scan.scan(awkward), line_dedup.dedup_lines(awkward)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|MapIn", plan)
