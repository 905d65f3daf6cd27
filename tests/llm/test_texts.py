"""Exact and near duplicates, repeated strings, BPE and quality, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairstrand.llm import bpe, exact_dedup, near_dedup, quality, substring_dedup, suffixes, tokens
from pairstrand.llm.settings import VOCABULARY


def body(t):
    return "" if t is None else t


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- exact -----------------------------------------------------------------------------------------------------------


def test_exact_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[body(r["text"])].append(r["doc_id"])
    want = Counter()
    for r in rows:
        own = groups[body(r["text"])]
        keep = max((i for i in own if i is not None), default=None)
        want[(r["doc_id"], keep, len(own), r["doc_id"] == keep, hashlib.sha256(body(r["text"]).encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs)
    assert Counter(tuple(r) for r in got.collect()) == want
    smallest = by_id(exact_dedup.exact_groups(docs.where("doc_id in (8, 9) or text is null"), keep="smallest"))
    assert smallest[8]["keep_id"] == 8


def test_drop_copies(docs, no_docs):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({body(r["text"]) for r in docs.collect()})
    assert {r["doc_id"] for r in rows if body(r["text"]) == body(docs.where("doc_id = 8").first()["text"])} == {8}
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_colliding_hashes_stay_apart(spark, docs, monkeypatch):
    """All texts are given one MD5: grouping compares bytes, and rows find their groups by SHA-256."""
    want, kept = exact_dedup.exact_groups(docs).collect(), exact_dedup.drop_copies(docs).collect()
    monkeypatch.setattr(exact_dedup.F, "md5", lambda _: F.lit("0" * 32))
    assert exact_dedup.exact_groups(docs).select(F.md5("text_sha256")).distinct().count() == 1  # the patch holds
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == Counter(map(tuple, want))
    assert Counter(map(tuple, exact_dedup.drop_copies(docs).collect())) == Counter(map(tuple, kept))


# -- near ------------------------------------------------------------------------------------------------------------

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = SPLIT.findall(body(text).translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(sets):
    """Components of documents (id to its sets) under links of 75 %."""
    ids = list(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[i] for y in sets[j]):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("few", "block"), [(None, None), (0, 7)])
def test_near_groups(plain_docs, monkeypatch, few, block):
    if few is not None:  # all bands by way of families
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = {r["doc_id"]: [shingle_set(r["text"])] for r in plain_docs.collect()}
    want = brute_components(sets)
    got = by_id(near_dedup.near_groups(plain_docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i][0]), c, c == i) for i, c in want.items()}


def several_texts(spark):
    """Ids with several texts: equal to others' texts, near copies of them, without words, and nobody's copies."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    more = lambda t: t + " tail"
    rows = [(5, a), (3, b), (5, b), (7, more(a)), (8, c), (8, None), (8, ""), (9, more(c)), (9, more(a + " " + c)), (2, None), (2, " "), (1, "x"), (1, "y"), (4, "y"), (12, b), (12, b), (None, a), (3, b)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_near_groups_of_ids_with_several_texts(spark):
    rows, df = several_texts(spark)
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingle_set(t))
    want = brute_components(sets)
    assert want[5] == want[7] == want[3] == 3
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect())
    assert got == Counter((i, len(shingle_set(t)), None if i is None else want[i], i is None or want[i] == i) for i, t in rows)


def test_near_stage_loses_no_text(spark, tmp_path):
    """What the stage takes out is a near copy of something that stays, row by row."""
    from pairstrand.llm import stages

    rows, df = several_texts(spark)
    kept = Counter((r["doc_id"], r["text"]) for r in stages.near_stage(spark, df, str(tmp_path)).collect())
    texts = {(i, body(t)) for i, t in rows if i is not None and shingle_set(t)}
    groups = brute_components({k: [shingle_set(k[1])] for k in texts})
    least = defaultdict(list)
    for k, g in groups.items():
        least[g].append((k[0], hashlib.md5(k[1].encode()).digest(), k))
    stay = {min(v)[2] for v in least.values()}
    assert kept == Counter((i, t) for i, t in rows if i is None or not shingle_set(t) or (i, body(t)) in stay)
    assert (5, rows[0][1]) in kept and (3, rows[1][1]) in kept and (5, rows[1][1]) not in kept


def test_near_groups_of_copies_around_the_threshold(spark):
    """One text's copies with three other words each: most pairs are just too different, some are links, all meet in bands."""
    rng = np.random.default_rng(12)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(400):
        own = list(base)
        for j in rng.choice(120, 3, replace=False).tolist():
            own[j] = f"n{k}x{j}"
        rows.append((k, " ".join(own)))
    sets = {k: [shingle_set(t)] for k, t in rows}
    want = brute_components(sets)
    assert 1 < len(set(want.values())) < 400
    got = by_id(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_near_groups_odd(docs, no_docs):
    got = near_dedup.near_groups(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert near_dedup.near_groups(no_docs).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.95):
        n = 4000
        both = int(n * 2 * share / (1 + share))
        pool = np.unique(rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
        for make in (near_dedup.wide_sketches, near_dedup.tight_sketches):
            s = make(np.concatenate([a, b]), np.array([len(a), len(b)]))
            got, filled = near_dedup.estimate(s[:1], s[1:])
            assert abs(got[0] - share) < 5 * np.sqrt(share * (1 - share) / filled[0]) + 0.01


# -- repeated strings ------------------------------------------------------------------------------------------------


def brute_removals(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def removed(df):
    return Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in df.collect())


#: As it is; anchors split over shards that are merged; split anchors made longer; stretches.
SUFFIX_SETTINGS = [{}, {"SHARD_BYTES": 1500, "SHARDS": 10_000}, {"SHARD_BYTES": 1500, "SHARDS": 2}, {"SHARD_BYTES": 700, "SHARDS": 1, "STRETCH": 1000}]


@pytest.mark.parametrize("settings", SUFFIX_SETTINGS)
def test_removals(docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip([r["doc_id"] for r in rows], brute_removals([body(r["text"]).encode() for r in rows], 400), strict=True))
    got = substring_dedup.removals(docs)
    assert removed(got) == want
    assert all(r["text"].encode() == b"" or hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_removals_of_nothing(no_docs, plain_docs):
    assert substring_dedup.removals(no_docs).count() == 0
    rows = plain_docs.collect()
    for length in (400, 200, 53):
        want = Counter(zip([r["doc_id"] for r in rows], brute_removals([body(r["text"]).encode() for r in rows], length), strict=True))
        assert removed(substring_dedup.removals(plain_docs, length)) == want


@pytest.mark.parametrize("settings", [{"SHARD_BYTES": 4000}, {"SHARD_BYTES": 4000, "SHARDS": 2}])
def test_one_anchor_in_many_texts(spark, monkeypatch, settings):
    """A passage between all kinds of neighbours: its anchor's segments are all different, and more than one shard holds."""
    for name, value in settings.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rng = np.random.default_rng(8)
    filler = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = filler(300)
    ahead, after = [filler(300) for _ in range(4)], [filler(300) for _ in range(4)]
    texts = [filler(40) + (ahead[k % 4][-(k % 290) :] if k % 3 else filler(200)) + passage + (after[k % 4][: k % 171] if k % 2 else "") + filler(150) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter(zip(range(120), brute_removals([t.encode() for t in texts], 400), strict=True))
    assert removed(substring_dedup.removals(docs)) == want


def test_equal_md5s_are_different_texts(spark):
    """Two texts of one MD5 (a published pair of blocks): neither is a copy of the other."""
    one = bytes.fromhex("d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99fd91dbdf280373c5bd8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1ec69821bcb6a8839396f9652b6ff72a70")
    two = bytes.fromhex("d131dd02c5e6eec4693d9a0698aff95c2fcab50712467eab4004583eb8fb7f8955ad340609f4b30283e4888325f1415a085125e8f7cdc99fd91dbd7280373c5bd8823e3156348f5bae6dacd436c919c6dd53e23487da03fd02396306d248cda0e99f33420f577ee8ce54b67080280d1ec69821bcb6a8839396f965ab6ff72a70")
    assert one != two and hashlib.md5(one).digest() == hashlib.md5(two).digest()
    keys = spark.createDataFrame([(bytearray(one),), (bytearray(two),)], "body binary").select(substring_dedup.text_key(F.col("body")).alias("k"))
    assert keys.distinct().count() == 2


def test_search_of_shards():
    rng = np.random.default_rng(9)
    for _ in range(150):
        one, other = ([bytes(rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), rng.choice([0, 1, 3, 9, 40]))) for _ in range(rng.integers(1, 6))] for _ in range(2))
        length = int(rng.integers(1, 20))
        sets = [{s[i : i + length] for s in x for i in range(len(s) - length + 1)} for x in (one, other)]
        want = [[[s[i : i + length] in y for i in range(len(s) - length + 1)] for s in x] for x, y in ((one, sets[1]), (other, sets[0]))]
        assert [[m.tolist() for m in x] for x in suffixes.starts_in_both(one, other, length)] == want


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(150):
        strings = [bytes(rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), rng.choice([0, 1, 3, 9, 40]))) for _ in range(rng.integers(1, 6))]
        strings.append(strings[0])
        size = np.array([len(s) for s in strings])
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(strings), np.uint8)
        if not len(data):
            continue
        order, _ = suffixes.suffix_array(data, start, size)
        named = [(s[i:], k) for k, s in enumerate(strings) for i in range(len(s))]
        assert [named[i] for i in order] == sorted(named, key=lambda x: (x[0], x[1]))
        length = int(rng.integers(1, 12))
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        assert [x.tolist() for x in suffixes.repeated_starts(strings, length)] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


# -- BPE -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("by_library", [False, True])
def test_codec_is_the_library(library, by_library):
    rng = np.random.default_rng(3)
    signs = list("ab'stdmrevl  \n\t\r\x0b12é☃漢字🎉ñ.,!'’  \x85\x1c²½ٱ०") + ["<|endoftext|>", "'ll", " the", "ing"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)] + ["", None, "a" * 3000, "a'sample 's''s", "    ", "<|endoftext|>" * 3]
    codec = bpe.codec(VOCABULARY, by_library)
    want = [x.ids for x in library.encode_batch([body(t) for t in texts], add_special_tokens=False)]
    got, decoded = [], []
    for _, ids, counts in codec.encode_batch(texts):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        decoded += codec.decode_batch(ids, counts)
    assert got == want
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in want]


def test_fragments_of_one_key_stay_apart(library, monkeypatch):
    """All long fragments are given the same hash: their bytes tell them apart."""
    codec = bpe.Codec(VOCABULARY)
    monkeypatch.setattr(codec, "_byte_key", np.zeros(256, np.uint64))
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 20))) for _ in range(30)) for _ in range(60)]
    got = [x.tolist() for k in range(0, 60, 20) for _, ids, counts in codec.encode_batch(texts[k : k + 20]) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_broken_ids(library):
    codec = bpe.codec(VOCABULARY)
    ids = np.array([223, 128, 50256, 10**6, -1, 447])
    assert codec.decode_batch(ids, np.array([6])) == [library.decode([223, 128, 50256, 447], skip_special_tokens=False)]


def test_round_trip(docs, no_docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode(body(r["text"]), add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in tokens.round_trip(docs, VOCABULARY).collect()) == want
    assert tokens.round_trip(no_docs, VOCABULARY).count() == 0
    back = tokens.decode(tokens.encode(docs, VOCABULARY), VOCABULARY)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], body(r["text"])) for r in rows)


# -- quality ---------------------------------------------------------------------------------------------------------


def test_quality_learns_and_keeps(spark, docs, no_docs):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "stone", "river", "and", "light", "was", "seen", "over", "hill"]
    good = [" ".join(rng.choice(vocabulary, 60)) + "." for _ in range(150)]
    bad = ["!! ".join(rng.choice(vocabulary, 60)).upper() for _ in range(75)] + [" ".join(np.repeat(rng.choice(vocabulary, 8), 8)) for _ in range(75)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    forest = quality.fit(texts, labels.where("doc_id % 3 <> 0 or doc_id is null"))
    held = quality.score(texts, forest).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([(r["score"] >= quality.THRESHOLD) == r["quality"] for r in held]) > 0.95
    got = quality.score(docs, forest)
    assert got.count() == docs.count() and got.where("score between 0 and 1").count() == docs.count()
    kept = quality.keep_good(docs, forest)
    assert kept.columns == docs.columns
    assert quality.score(no_docs, forest).count() == 0
    nothing = quality.fit(texts, labels.limit(0))
    assert quality.score(texts, nothing).where("score < 0.999").count() == 0
    ones = quality.fit(texts, labels.where("quality = 0"))
    assert quality.score(texts, ones).where("score > 0.1").count() == 0


def test_forest_is_its_trees():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    f = quality.grow(x, y)

    def walk(t, row):
        i = 0
        while f.left[t, i] != i:
            i = f.left[t, i] if row[f.feature[t, i]] <= f.threshold[t, i] else f.right[t, i]
        return f.value[t, i]

    slow = [1 / (1 + np.exp(-(f.base + sum(walk(t, row) for t in range(len(f.feature)))))) for row in x[:50]]
    assert np.allclose(f.score(x[:50]), slow)
    assert ((f.score(x) > 0.5) == y).mean() > 0.97
