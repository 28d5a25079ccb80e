"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import chunk_dedup, decontaminate, html_template, mixing, nbsvm, quality_rules, rolling, simhash, suffix_dedup, token_counts, url_graph
from gridwright.llm.components import components, stars
from gridwright.llm.scratch import Scratch

LONG = "word " * 30_000
AWKWARD = [None, "", " \n\t ", "x", "a b", "é ü 日本", LONG, "same text of some words here", "same text of some words here", "#" * 5000, "a\u2581b  c", "\ud7ff\x00end"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", -1, "x", 9, 9.0, "w") for i, t in enumerate(AWKWARD)]
    rows += [rows[7], rows[7]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, size bigint, score double, kind string").cache()


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


def words_of(n, seed, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


# --- 1 quality classifier


def test_classifier_on_held_out_rows(spark):
    rng, rows = random.Random(0), []
    for i in range(600):
        w = words_of(rng.randint(5, 60), i)
        good = rng.random() < 0.8
        rows.append((i, " ".join(w if good else [x + rng.choice(["###", "$$$"]) for x in w]), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (5, rows[5][2])], "doc_id bigint, quality int")
    model = nbsvm.train(docs, labels, "quality")
    got = {r.doc_id: r for r in nbsvm.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    late = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert len(late) > 80 and sum(p == q for p, q in late) / len(late) > 0.98
    again = nbsvm.train(docs, labels, "quality")
    assert np.array_equal(again.weight, model.weight)
    changed = labels.withColumn("quality", F.when(nbsvm.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(nbsvm.train(docs, changed, "quality").weight, model.weight)  # held-out labels teach nothing


def test_sample_is_bounded_in_rows_and_features(spark, monkeypatch):
    rows = [(1, f"word{i} more words") for i in range(2000)] + [(i, f"text {i} of some words {i % 3}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda found, good: seen.append(found))
    nbsvm.train(docs, labels, "quality")
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0]) == len(ids)
    monkeypatch.setattr(nbsvm, "MOST_FEATURES", 100)
    nbsvm.train(docs, labels, "quality")
    assert 0 < sum(map(len, seen[1])) <= 100


def test_dual_descent_separates():
    x = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    v = [np.ones(len(r)) for r in x]
    y = np.array([1.0, -1, 1, -1])
    w, b = nbsvm.descend(x, v, y, np.full(4, 10.0), passes=100)
    assert all(yi * (w[r].sum() + b) > 0.9 for r, yi in zip(x, y))


def test_classifier_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id bigint, quality int")
    out = nbsvm.score(awkward, nbsvm.train(awkward, labels, "quality")).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert nbsvm.score(nothing, nbsvm.train(nothing, labels.limit(0), "quality")).count() == 0


# --- 2 SimHash


def test_walk_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    keys = [base]
    for _ in range(5):
        x = base.copy()
        for _ in range(3):
            m = rng.random(len(x)) < 0.6
            x[m] ^= np.uint64(1) << rng.integers(0, 64, m.sum()).astype(np.uint64)
        keys.append(x)
    keys = np.unique(np.concatenate(keys))
    for budget in (0, 1, 2, 4):
        i, j = simhash.walk(keys, 0, budget)
        want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if int(keys[a] ^ keys[b]).bit_count() <= budget}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_walk_thins_to_what_all_pairs_need(monkeypatch):
    rng = np.random.default_rng(5)
    keys = np.full(400, np.uint64(0x0123456789ABCDEF))
    for _ in range(3):
        keys = keys ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    keys = np.unique(keys)
    length = lambda left, right: np.bitwise_count(keys[left] ^ keys[right])

    def thin(left, right):
        at = simhash.forest(len(keys), left, right, length(left, right))
        return left[at], right[at]

    everything = simhash.walk(keys, 0, 4)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    few = simhash.walk(keys, 0, 4, thin)
    assert len(few[0]) < len(everything[0]) / 2
    want, got = thin(*everything), thin(*few)
    assert len(got[0]) == len(want[0]) and length(*got).sum() == length(*want).sum()


@pytest.mark.parametrize("limit", [50_000, 12])
def test_links_connect_what_brute_force_does(spark, limit):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base[rng.integers(0, 8, 60)] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)]))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    want = stars(len(keys), *np.nonzero(near))
    signed = keys.view(np.int64).tolist()
    leaves = spark.createDataFrame([(0, x, x) for x in signed], "t int, fp bigint, node bigint")
    scratch = Scratch(spark, "test")
    root = {r.node: r.root for r in components(simhash.links(leaves, 2, scratch, limit), scratch).collect()}
    groups = lambda labels: sorted(sorted(s) for s in labels.values())
    ours, theirs = defaultdict(list), defaultdict(list)
    for k, w in zip(signed, want):
        ours[root.get(k, k)].append(k)
        theirs[w].append(k)
    assert groups(ours) == groups(theirs)


def test_near_duplicates_of_table(spark, awkward, nothing):
    out = simhash.near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[8].component_id == 7 and by[None].component_id is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = Counter(r.doc_id for r in simhash.one_of_each(awkward, tables=4).collect())
    assert kept[8] == kept[1] == 0 and kept[0] == kept[None] == kept[7] == 1


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick brown fox ÉÀ jumps the quick brown fox"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_more_tables_find_more(spark):
    w = words_of(200, 3)
    rows = [(0, " ".join(w))] + [(i, " ".join(w[: 20 * i] + ["changed"] + w[20 * i + 1 :])) for i in range(1, 6)] + [(9, " ".join(words_of(200, 4)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, tables=16, budget=3).collect()}
    assert kept == {0, 9}


def edited(words, share, rng):
    return [x if rng.random() > share else "new" + x for x in words]


def test_near_copies_are_found_and_confirmed(spark):
    rng, rows, close = random.Random(6), [], {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(160):
        a = words_of(rng.randint(60, 300), 100 + i, "abcdefghijklmnop")
        b = edited(a, rng.choice([0.005, 0.01, 0.02, 0.15, 0.3]), rng)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        close[2 * i + 1] = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(i in kept for i in range(0, 320, 2))
    near, far = [i for i, x in close.items() if x >= 0.8], [i for i, x in close.items() if x < 0.7]
    assert len(near) > 60 and len(far) > 40
    assert sum(i not in kept for i in near) / len(near) >= 0.9 and all(i in kept for i in far)


def test_links_are_between_texts_not_ids(spark):
    a, b = (" ".join(words_of(80, x)) for x in (1, 2))
    near = a.split()
    near[40] = "changed"
    rows = [(1, " ".join(near)), (3, a), (3, b), (9, b), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, tables=16, budget=3, similarity=0.8).collect())
    assert got == [(1, 1), (3, 1), (3, 3), (5, 5), (9, 3)]
    kept = lambda rows, **how: sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **how).collect()), key=str)
    assert kept([(3, a), (7, a), (7, b)]) == sorted([(3, a), (7, b)], key=str)
    assert kept([(3, a)] * 5 + [(4, a), (None, b), (None, b)]) == sorted([(3, a), (None, b)], key=str)
    assert kept([(3, b), (3, b), (3, a), (3, " ".join(near))])[0][0] == 3 and len(kept([(3, b), (3, b), (3, a), (3, " ".join(near))])) == 2


def test_forest_is_minimal():
    rng = np.random.default_rng(4)
    left, right, length = rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(0, 4, 150)
    at = simhash.forest(40, left, right, length)
    label, want = list(range(40)), 0
    for i in np.argsort(length, kind="stable"):
        a, b = label[left[i]], label[right[i]]
        if a != b:
            want += length[i]
            label = [a if x == b else x for x in label]
    assert length[at].sum() == want and len(at) == 40 - len(set(label))
    assert len(set(stars(40, left[at], right[at]))) == len(set(label))


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[105] == got[102] == 100


# --- 3 token counts


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return token_counts.Vocabulary.load(tokenizers.path("piece_bpe_32k.model"))


def test_counts_equal_the_library(vocabulary):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    alphabet = "aabbcdeettthhinos  \n\t\u2581éßあ日😀①<s>/\r.,12=='"
    texts = ["", " ", "\n", "<s>x</s> <unk> <0x0A>", "a" * 3000, "ab" * 2000, " " * 500, "▁▁a▁", LONG[:5000]]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    assert token_counts.Counter(vocabulary).count(texts) == [len(sp.encode(x)) if x else 0 for x in texts]


def test_merging_is_synchronous_and_exact():
    pieces = [("aa", -1.0), ("aaaa", -2.0), ("ab", -3.0), ("aba", -2.5), ("a", -9.0), ("b", -9.1)]
    v = token_counts.Vocabulary.of(pieces)
    rank = {p: -s for p, s in pieces}

    def slow(word):
        s = list(word)
        while True:
            best = min(((rank[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in rank), default=None)
            if best is None:
                return len(s)
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    rng = random.Random(1)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert v.counts(words).tolist() == [slow(w) for w in words]


def test_long_words_equal_the_library_and_take_seconds(vocabulary):
    import time

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ABCDEFabcdef0123456789+/", "ab", "日本語中国人大学生", "a\u00e9\U0001f600x", "=-_.", "the"]
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (150, 201, 700, 3000)] + ["a" * 5000, "the" * 2000, "ing" * 900 + " x"]
    assert token_counts.Counter(vocabulary).count(texts) == [len(sp.encode(t)) for t in texts]
    long = "".join(rng.choice(kinds[2]) for _ in range(1 << 20))
    began = time.process_time()
    assert token_counts.Counter(vocabulary).count([long]) == [len(sp.encode(long))]
    assert time.process_time() - began < 30


def test_memory_of_words_is_bounded_in_characters(vocabulary, monkeypatch):
    """Lines without spaces are words of their own; a task doesn't gather them."""
    counter = token_counts.Counter(vocabulary)
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh日本") for _ in range(3000)) for _ in range(30)]
    once = counter.count(lines + ["a few short words"] * 3)
    assert max(map(len, counter.known)) <= token_counts.LONG_WORD and counter.size == sum(map(len, counter.known)) < 100
    assert counter.count(lines + ["a few short words"] * 3) == once
    monkeypatch.setattr(token_counts, "REMEMBERED_CHARS", 50)
    fresh = token_counts.Counter(vocabulary)
    for i in range(0, 30, 3):
        assert fresh.count([*lines[i : i + 3], f"other{i} words{i}"])[:3] == once[i : i + 3]
        assert fresh.size < 200


def test_token_counts_awkward(awkward, nothing, vocabulary):
    out = {r.doc_id: r for r in token_counts.token_counts(awkward, vocabulary).collect()}
    assert out[0].n_tokens == out[0].n_bytes == out[1].n_tokens == 0
    assert out[6].over_limit and not out[4].over_limit and out[5].n_bytes == len(AWKWARD[5].encode())
    assert token_counts.token_counts(nothing, vocabulary).count() == 0


# --- 4 decontamination


def test_altered_questions_are_found(spark):
    item = "Alice has 12 apples and gives 5 of them to Bob, then she walks 3 km to the market to buy 12 pears."
    other = item.replace("12", "17").replace("5", "4").replace("Bob", "Tom").replace("3 km", "9 miles")
    torn = "Alice has 17 apples and gives 4 of them to Tom"
    mixed = "the man gave 3 coins and took 3 pens while she gave 3 coins and took"
    rows = [(1, f"Before it. {other} And after."), (2, item.upper()), (3, f"x {torn} y"), (4, "nothing of the kind is in here at all, not one window of it"), (5, None), (6, "the man gave 7 coins and took 8 pens while she gave 7 coins and took"), (7, "the man gave 7 coins and took 7 pens while she gave 7 coins and took")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, mixed)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert (1, 10) in got and got[1, 10].n_altered > 0
    assert (3, 10) in got and (7, 13) in got and got[7, 13].n_windows > 3
    assert not any(d in (4, 5) for d, _ in got)
    assert got.get((6, 13)) is None or got[6, 13].n_windows < got[7, 13].n_windows  # 3 -> 7 and 3 -> 8 within a window is no match
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_names_that_open_a_sentence(spark):
    pairs = {
        0: ("Alice has 3 apples. How many apples does Alice have left if she eats 2?", "Bob has 5 apples. How many apples does Bob have left if she eats 4?"),
        1: ("Élodie paie 12 euros pour des livres et Éric paie le double", "Anna paie 15 euros pour des livres et Özgür paie le double"),
        2: ("Every day Sam runs 4 km to work and back again with Kim", "Every day Lea runs 9 miles to work and back again with Jo"),
    }
    bench = spark.createDataFrame([(i, a) for i, (a, _) in pairs.items()], "item_id bigint, text string")
    rows = [(i, f"Some words before it.\n{b} And more behind it.") for i, (_, b) in pairs.items()]
    rows += [(9, "Bob has 5 apples. How many apples does Tim have left if she eats 4?")]  # two names where the item has one
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert set(got) >= {(0, 0), (1, 1), (2, 2)} and set(got) <= {(0, 0), (1, 1), (2, 2), (9, 0)} and got.get((9, 0), 0) < got[0, 0]


def test_recall_on_altered_items(spark):
    rng, items, rows = random.Random(12), [], []
    names, units, upper = "Ada Ben Cleo Dan Eva Finn Gus Hana".split(), "km kg miles hours euros".split(), lambda x: x[0].upper() + x[1:]
    for i in range(200):
        w = words_of(rng.randint(12, 40), 900 + i)
        slots = sorted(rng.sample(range(len(w)), len(w) // 6))
        kinds = [rng.choice(["number", "name", "unit"]) for _ in slots]
        make = lambda: upper(" ".join(dict(zip(slots, [{"number": str(rng.randint(2, 999)), "name": rng.choice(names), "unit": f"{rng.randint(2, 99)} {rng.choice(units)}"}[k] for k in kinds])).get(j, x) for j, x in enumerate(w)))  # noqa: B023, E731
        items.append((i, make()))
        rows.append((i, " ".join(words_of(30, 5000 + i)) + ". " + make() + ". " + " ".join(words_of(30, 7000 + i))))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len({(i, i) for i in range(200)} & found) >= 180 and all(a == b for a, b in found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    pool = words_of(12, 1)
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    items = [" ".join(rng.choice(pool) for _ in range(rng.randint(6, 14))) for _ in range(10)] + texts[0:1]
    texts += [f"zz {items[0]} zz", f"{items[1]}"]
    n = decontaminate.WINDOW
    want = set()
    for d, t in enumerate(texts):
        have = {tuple(t.split()[i : i + m]) for m in range(1, n + 1) for i in range(len(t.split()) - m + 1)}
        for q, item in enumerate(items):
            w = item.split()
            m = min(n, len(w))
            if any(tuple(w[i : i + m]) in have for i in range(len(w) - m + 1)) and m >= decontaminate.LITERALS:
                want.add((d, q))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want


def test_verbatim_copies_are_found(spark):
    """Short items, items of numbers and names, and copies in other case, lines or surroundings."""
    items = {0: "What is 7 + 8?", 1: "add 12 kg 13 kg 14 kg 15 kg 16 kg 17 kg", 2: "What did Anna Berg tell Carl Dorn?", 3: "the river ran past Anna and Berg while Carl and Dorn slept in École Haute", 4: "plain words of a row that is only here to differ"}
    rows = {0: f"before {items[0]} behind", 1: f"x {items[1]} y", 2: f"Question: {items[2]}", 3: items[3].upper(), 4: items[3].lower(), 5: items[3].replace(" ", "\n"), 6: f'("{items[2]}")', 7: "What is 7 + 9 or add 12 kg 13 kg 14 kg 15 kg 16 kg 18 kg"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_altered) for r in decontaminate.contaminated(docs, bench).collect()}
    n = len(items[3].split()) - decontaminate.WINDOW + 1
    # of item 1 the documents 1 and 7 share windows of ten tokens too
    assert {k: v for k, v in got.items() if k[0] != 7} == {(0, 0): (1, 0), (1, 1): (4, 0), (2, 2): (1, 0), (3, 3): (n, 0), (4, 3): (n, 0), (5, 3): (n, 0), (6, 2): (1, 0)}
    assert set(got) - {(7, 1)} == {k for k in got if k[0] != 7}


def test_benchmark_in_blocks(spark, monkeypatch):
    texts = [" ".join(words_of(30, i)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, docs, item_col="doc_id").collect()}
    assert got == {(i, i) for i in range(6)} and decontaminate.clean(docs, docs, item_col="doc_id").count() == 0


def test_decontamination_awkward(awkward, nothing):
    assert decontaminate.contaminated(awkward, nothing, item_col="doc_id").count() == 0
    assert decontaminate.contaminated(nothing, awkward, item_col="doc_id").count() == 0
    assert decontaminate.clean(awkward, nothing, item_col="doc_id").count() == awkward.count()


# --- 5 chunks


def test_gear_equals_the_rolling_loop():
    rng = random.Random(0)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (300, 0, 1, 77)]
    data, offsets = rolling.laid_out(texts)
    got, at = chunk_dedup.gear(data, offsets), 0
    for t in texts:
        h = 0
        for b in t:
            h = (h * 2 + int(chunk_dedup.GEAR[b])) & 0xFFFF
            assert int(got[at]) & 0xFFFF == h
            at += 1


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(1)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    own, start, end, digest = chunk_dedup.chunks([body, b"", b"xyz" + body, b"a" * 2000])
    for i, n in ((0, 4000), (2, 4003), (3, 2000)):
        s, e = start[own == i], end[own == i]
        assert s[0] == 0 and e[-1] == n and (s[1:] == e[:-1]).all() and (e - s).max() <= chunk_dedup.LONGEST
    first, moved = set(digest[own == 0].tolist()), set(digest[own == 2].tolist())
    assert len(first & moved) >= len(first) - 3


def brute_chunks(text):
    """Ends by the definition, byte by byte."""
    c, h, strong, ends = chunk_dedup, 0, -1, []
    mask = lambda bits: ((1 << bits) - 1) << (c.REACH - bits)
    for i, b in enumerate(text):
        h = (h * 2 + int(c.GEAR[b])) & 0xFFFF
        if not h & mask(c.BITS) or i == len(text) - 1:
            strong = i
            ends.append(i + 1)
        elif i - strong > c.QUIET and not h & mask(c.WEAK):
            ends.append(i + 1)
    out, start = [], 0
    for e in ends:
        for s in range(start, e, c.LONGEST):
            out.append((s, min(s + c.LONGEST, e)))
        start = e
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, small, request):
    if small:
        request.getfixturevalue("small_batches")
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [make(400), make(260)]
    texts = [make(300) + shared[i % 2] + make(200) for i in range(12)] + [make(500) for _ in range(8)] + [None, "", "a" * 3000]
    texts += [texts[0], make(700) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cuts = [[(s, e, (t or "")[s:e]) for s, e in brute_chunks((t or "").encode())] for t in texts]
    count = Counter(x for c in cuts for _, _, x in c)
    want, stays = {}, set()
    for d, c in enumerate(cuts):
        made = []
        for s, e, x in c:
            if count[x] > 1:
                if made and made[-1][1] == s:
                    made[-1][1] = e
                else:
                    made.append([s, e])
        made = [m for m in made if m[1] - m[0] >= chunk_dedup.RUN]
        if made:
            want[d] = made
    got = {r.doc_id: r for r in chunk_dedup.repeats(docs).collect()}
    assert {d: [list(x) for x in r.runs] for d, r in got.items()} == want
    assert set(range(12)) <= set(got) and not set(range(12, 20)) & set(got)
    inside = lambda d, s, e: any(a <= s and e <= b for a, b in want.get(d, []))
    lone = {x for d, c in enumerate(cuts) for s, e, x in c if count[x] > 1 and not inside(d, s, e)}  # copies that stay may stand outside of runs
    kept, within = sum(r.n_repeated - r.n_redundant for r in got.values()), {x for d, c in enumerate(cuts) for s, e, x in c if inside(d, s, e)}
    assert sum(len(x) for x in within - lone) <= kept <= sum(len(x) for x in within)


def test_repeated_rows_have_one_list_of_runs(spark):
    text = " ".join(words_of(300, 3))
    docs = spark.createDataFrame([(1, text)] * 60 + [(2, text), (3, " ".join(words_of(300, 4)))], "doc_id bigint, text string").repartition(4)
    got = chunk_dedup.repeats(docs).collect()
    assert len(got) == 61 and {(r.doc_id, r.n_repeated, len(r.runs)) for r in got} == {(1, len(text), 1), (2, len(text), 1)}


def test_repeats_awkward(awkward, nothing):
    got = {r.doc_id for r in chunk_dedup.repeats(awkward).collect()}
    assert 6 in got and 0 not in got and chunk_dedup.repeats(nothing).count() == 0


# --- 6 quality rules


def test_counts_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        lines = [" ".join(rng.choice(["a", "b", "cé", "#$", ""]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 5))]
        text = "\n".join(lines)
        w, f = text.split(), quality_rules.Facts(text.encode())
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        full = [x for x in lines if x.strip()]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_repeat_words, f.n_dup_lines) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(covered), len(full) - len(set(full)))


def test_order_follows_rejections_per_cost_and_verdicts_dont(spark):
    e = quality_rules.Estimate
    assert quality_rules.order([e("a", 1.0, 10, 5), e("b", 0.1, 10, 5), e("c", 0.1, 10, 0), e("d", 0.01, 10, 0)]) == ["b", "a", "d", "c"]
    texts = ["plain words in a line that are quite fine here", "### $$$ %%% a b c d e f g h i j", "TO BE OR NOT TO BE THAT IS THE QUESTION HERE"]
    for names in (list(quality_rules.RULES), list(reversed(quality_rules.RULES))):
        rules = [quality_rules.RULES[x] for x in names]
        assert [quality_rules.verdict(quality_rules.Facts(t.encode()), rules) for t in texts] == [True, False, False]


def test_keep_counts_only_what_it_asks_for(monkeypatch):
    asked = []
    monkeypatch.setattr(quality_rules, "repeated_words", lambda words, width=5: asked.append(len(words)) or 0)
    cascade = [quality_rules.BASE["too_short"], quality_rules.RULES["symbol_heavy"], quality_rules.BASE["repetitive"]]
    verdicts = [not any(rule(f) for rule in cascade) for f in map(quality_rules.Facts, [b"few", b"# # # # a b c d e f g h", b"these are ten plain words and so they are all kept"])]
    assert verdicts == [False, False, True] and asked == [11]


def test_rules_awkward(awkward, nothing):
    out = quality_rules.judge(awkward).collect()
    assert len(out) == awkward.count() and all(not r.kept for r in out if r.n_words < 10)
    assert quality_rules.judge(nothing).count() == quality_rules.keep(nothing).count() == 0
    kept = quality_rules.keep(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in out)


# --- 7 templates


def page(i, host="h.example", body=""):
    words = " ".join(words_of(30, i))
    return (i, f"https://{host}/p/{i}", f"<html><head><title>t {i}</title><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href=/x>menu</a></ul></nav><div class='ad'>buy</div><article><h1>Head {i}</h1><p>{words} &amp; more<p>second <b>bold</b><br>{i}</article>{body}<footer>&copy; host</footer></body></html>", f"Head {i}\n{words} & more\nsecond bold {i}")


def test_extracts_articles(spark):
    rows = [page(i, f"h{i % 3}.example", "<div class=comments><p>reader says</div>") for i in range(30)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    for most in (1 << 24, 0):  # all templates broadcast, or joined by host
        got = {r.page_id: r for r in html_template.main_text(pages, template_bytes=most).collect()}
        assert {i: r.text for i, r in got.items()} == {r[0]: r[3] for r in rows}
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_slots_that_differ_without_an_article(spark):
    rows = [(i, f"http://n.example/{i}", f"<body><div class=menu>m</div><div class=top>same for all</div><div class=c><p>own {' '.join(words_of(8, i))}</p></div></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_template.main_text(pages).collect()}
    assert got == {i: f"own {' '.join(words_of(8, i))}" for i in range(8)}


def test_rare_constant_blocks_are_closed(spark):
    """A block on 5 pages of a host is boilerplate whether the host has 300 pages or 600."""
    rows = []
    for n in (300, 600):
        rows += [(n * 10 + i, f"http://n{n}.example/{i}", f"<body>{'<div class=strip>same for five</div>' if i % 60 == 0 and i < 300 else ''}<div class=c><p>own {n} {i}</p></div></body>") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (1 << 24, 0):
        got = {r.page_id: r.text for r in html_template.main_text(pages, template_bytes=most).collect()}
        assert got == {n * 10 + i: f"own {n} {i}" for n in (300, 600) for i in range(n)}


def test_regions_of_unnamed_elements(spark):
    """Without telling names: what varies is extracted, a layout of some pages has its own region, template text isn't."""
    def body(i):
        words = " ".join(words_of(40, i))
        if i % 3:
            return f"<div class=qa>the same long legal words on every page of this host, more of them than of its own text {'and so on ' * 60}</div><div class=qb><div class=qc><h2>Head {i}</h2><p>{words}<p>end {i}</div><div class=qd>short {i}</div></div>", f"Head {i}\n{words}\nend {i}"
        return f"<div class=wa>teaser {i}</div><div class=wb><p>{words}</p><section class=related-work>other {i}</section><p class=social-history>third {i}</p></div>", f"{words}\nother {i}\nthird {i}"

    rows = [(i, f"http://v.example/{i}", f"<html><body>{body(i)[0]}</body></html>", body(i)[1]) for i in range(24)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    for most in (1 << 24, 0):
        assert {r.page_id: r.text for r in html_template.main_text(pages, template_bytes=most).collect()} == {r[0]: r[3] for r in rows}


def test_gaps_of_valid_classes_are_the_slots(spark):
    """A line between two tags is template text if they are of one class, in one order, and cross no other class; in the same role others have text of their own."""
    own = "line of page {}"
    between = lambda i: "<i class=x></i>same line<i class=y></i>"
    marks = {
        "class": between,
        "vectors": lambda i: "<i class=x></i>same line" if i == 4 else between(i),
        "order": lambda i: "<i class=y></i>same line<i class=x></i>" if i > 5 else between(i),
        "nesting": lambda i: "<u class=w><i class=x></i></u>same line<i class=y></i>",
    }
    rows = []
    for h, (host, mark) in enumerate(marks.items()):
        for i in range(16):
            words = " ".join(words_of(30, i))
            other = ("<u class=w></u>" if host == "nesting" else "") + own.format(i)
            rest = ("" if host == "class" else "\nsame line") if i % 2 == 0 else f"\n{own.format(i)}"
            rows.append((100 * h + i, f"http://{host}.example/{i}", f"<body><div class=c><p>{words}</p>{other if i % 2 else mark(i)}</div></body>", words + rest))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(3)
    for most in (1 << 24, 0):
        assert {r.page_id: r.text for r in html_template.main_text(pages, template_bytes=most).collect()} == {r[0]: r[3] for r in rows}


def test_names_set_aside():
    assert all(map(html_template.set_aside, "ad ads ad-box adBanner comments comment-list site-footer cookie_notice nav sidebar-left share-buttons related-posts".split()))
    assert not any(map(html_template.set_aside, "related-work social-history ad-hoc share-price article content post-body notice-of-meeting adapter header1x shadow menu-engineering".split()))
    read = lambda x: html_template.extract(x, html_template.Reader())
    assert read("<article><p class=social-history>a<section class='related-work'>b</section><div class='ad-box'>c</div><form>d</form></article>") == "a\nb"
    assert read("<article>&am<b>p;</b> &amp; &lt;b&gt; x&nbsp;y</article>") == "&amp; & <b> x y"


def test_equivalence_classes_equal_vectors(spark):
    from html.parser import HTMLParser

    class Paths(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.count = [0], Counter()

        def handle_starttag(self, tag, attrs):
            own = ".".join([tag, *(v for _, v in attrs)])
            self.stack.append(html_template.digest(f"{self.stack[-1]}>{own}"))
            self.count[self.stack[-1]] += 1

        def handle_endtag(self, tag):
            self.stack.pop()

    rng, rows, vectors = random.Random(2), [], defaultdict(dict)
    for i in range(60):
        parts = [f"<div class='{rng.choice('abc')}'><b>{i}</b></div>" for _ in range(rng.randint(0, 3))] + [f"<section><i>x</i>{'<u>y</u>' * (i % 2)}</section>"] * (i % 4)
        rows.append((f"n{i}", f"<html><body>{''.join(parts)}<em>t</em></body></html>"))
        paths = Paths()
        paths.feed(rows[-1][1])
        for role, n in paths.count.items():
            vectors[role][i] = n
    pages = spark.createDataFrame(rows, "name string, html string").withColumn("host", F.lit("h")).repartition(5)
    found = html_template.classes(pages).where(f"role <> {html_template.ROOT_ROLE}").collect()
    group = lambda pairs: sorted(sorted(x) for x in pairs.values())
    ours, theirs = defaultdict(list), defaultdict(list)
    for r in found:
        ours[r.signature, r.pages, r.total].append(r.role)
    for role, v in vectors.items():
        theirs[tuple(sorted(v.items()))].append(role)
    assert group(ours) == group(theirs) and len(theirs) > 5


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<a \"", "<li></li>", "<!", "</x", "<p>x", "<div class=a>x", "<b>&amp;", "\"'>", "<ul><li><div>"])
def test_hostile_pages_take_seconds(piece):
    import time

    reader = html_template.Reader()
    for page in (piece * (400_000 // len(piece)), "<div>" * 40_000 + piece * (200_000 // len(piece)), "<ul><li><ul>" + "<div>" * 20_000 + piece * (200_000 // len(piece)) + ">"):
        began = time.process_time()
        html_template.extract(page, reader)
        assert time.process_time() - began < 10


def test_pages_awkward(spark):
    rows = [(1, None, None), (None, "http://a.b/", ""), (2, "nohost", "<p>x"), (2, "nohost", "<p>x"), (3, "http://a.b/c", "<<p>a < b<!-- open"), (4, "http://a.b", "<script>never closed <p>x</p>"), (5, "http://a.b", "<main>" + "<div>" * 3000 + "deep" + "</main>"), (6, "http://a.b", "<p>" + "x" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, host string")
    got = [(r.page_id, r.text) for r in html_template.main_text(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (None, ""), (2, "x"), (2, "x"), (3, "<\na < b"), (4, ""), (5, "deep"), (6, "x" * 2_000_000)], key=str)
    assert html_template.main_text(pages.limit(0)).count() == 0


# --- 8 mixing


def brute_mix(rows):
    """Rows one by one in the order of their keys, again and again, as long as any fits."""
    size = {}
    by = defaultdict(list)
    for at, (d, t, s) in enumerate(rows):
        text = (t or "").encode()
        words, found = text.split(), Counter()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        symbols, lines = sum(text.count(c.encode()) for c in "#*$%&|<>"), [x for x in text.split(b"\n") if x.strip()]
        n = len(words)
        w = max(0.05, (1 - min(1, symbols / max(1, n))) * (1 - len(covered) / max(1, n)) * (1 - (len(lines) - len(set(lines))) / max(1, len(lines))))
        by[s].append((mixing.key_rank(d, text, w), at, n))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(n for *_, n in by[s]) for s in names]
    goal = mixing.targets(totals, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for s, total, t in zip(names, totals, goal):
        epochs = int(t // total) if total else 0
        open_, taken = int(t - epochs * total), set()
        behind = sorted(by[s])
        while behind:
            behind = [x for x in behind if 1 <= x[2] <= open_]
            for i, (_, at, n) in enumerate(behind):
                if n > open_:
                    break
                open_ -= n
                taken.add(at)
            else:
                break
            behind = behind[i + 1 :]
        size |= {at: (n, total, t, n * (epochs + (at in taken))) for _, at, n in by[s]}
    return Counter((rows[at][0], *x) for at, x in size.items())


def test_targets_share_the_excess():
    got = mixing.targets([100, 10, 100], [3, 1, 2])
    assert got == [177.0, 20.0, 118.0] and mixing.targets([0, 0], [1, 1]) == [0, 0] and mixing.targets([], []) == []
    assert abs(sum(mixing.targets([50, 60, 70, 80], [3, 1, 2, 3])) - 390) < 1e-9


def test_mix_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words_of(rng.randint(0, 40), i)) + ("#" * rng.randint(0, 30)) + " again and again it is\n" * rng.choice([0, 0, 3]), rng.choice(["a", "b", "ä", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).collect()
    assert Counter(tuple(r) for r in out) == brute_mix(rows)
    got, per = {r.doc_id: r for r in out}, Counter()
    for d, _, s in rows:
        per[s] += got[d].taken
    assert all(abs(per[s] - got[d].target) <= 40 for d, _, s in rows)
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(mixed[d] * g.size == g.taken for d, g in got.items() if g.size)


@pytest.mark.parametrize(("plain", "words", "copies", "size"), [(700, 30, 400, 31), (40, 97, 400, 50), (0, 1, 500, 7)])
def test_mix_takes_part_of_equal_rows(spark, plain, words, copies, size):
    rows = [(i, " ".join(words_of(words, i)), "a") for i in range(plain)] + [(9000, " ".join(words_of(size, 9000)), "a")] * copies
    rows += [(10_000, "x " * ((plain * words + copies * size) // 2), "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    assert Counter(tuple(r) for r in out) == brute_mix(rows)
    taken, target = sum(r.taken for r in out if r.doc_id < 10_000), next(r.target for r in out if r.doc_id < 10_000)
    assert abs(taken - target) <= max(words, size)
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in out:
        want[r.doc_id] += r.taken // r.size
    assert mixed == want


def test_mix_fills_until_nothing_fits(spark):
    """A document that is half of its source ends the prefix; all others behind it still fit."""
    rows = [(i, f"w{i} " * 25, "a") for i in range(1600)] + [(2000, "long " * 41_000, "a")] + [(3000, "twice " * 40, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).collect()
    assert {(r.doc_id < 2000 or r.doc_id == 3000, r.taken // r.size) for r in out} == {(True, 2), (False, 1)}
    mixed = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert mixed == {i: 1 if i == 2000 else 4 if i == 3000 else 2 for i, _, _ in rows}


def test_mix_awkward(awkward, nothing):
    out = mixing.mix(awkward).collect()
    assert len(out) == awkward.count() and all(0 <= r.taken <= 2 * r.size for r in out)
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0
    assert mixing.mixed(awkward).columns == [*awkward.columns, "copy"]
    clash = mixing.mixed(awkward.withColumnRenamed("kind", "copy").withColumnRenamed("rid", "rank"))
    assert clash.columns[-1] == "copy_" and "rank" in clash.columns and clash.count() == mixing.mixed(awkward).count()


# --- 9 urls


def test_rules_and_hosts(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x?y#z"), (2, "https://a.example.com/en/"), (3, "http://example.com/fr/"), (4, "http://notcom/x"), (5, "http://x.net/es/1"), (6, "http://x.org"), (7, None), (8, "no scheme"), (9, "http://a.com?q=/en/"), (10, "x://y.com://z/en/")]
    pages = spark.createDataFrame([(*r, "") for r in rows], "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(pages).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4][2:] == (None, "allow") and got[5][2:] == ("net/es/", "block")
    assert got[6] == ("x.org", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][:2] == ("", "")
    assert got[9] == ("a.com", "", None, "allow") and got[10][:2] == ("y.com:", "//z/en/")


def test_propagation_equals_linear_algebra(spark):
    rng = np.random.default_rng(3)
    n = 12
    w = rng.integers(0, 4, (n, n)).astype(float) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(w, 0)
    w[:, 3] += 1  # a hub
    w[3, 3] = 0
    good, bad = rng.random(n) * (rng.random(n) < 0.4), rng.random(n) * (rng.random(n) < 0.4)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, w double")
    seeds = spark.createDataFrame([(f"h{i}", float(good[i]), float(bad[i])) for i in range(n)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(seeds, edges, Scratch(spark, "test")).collect()}
    down, up = w / np.maximum(w.sum(1, keepdims=True), 1e-300), w / np.maximum(w.sum(0, keepdims=True), 1e-300)
    fixed = lambda m, seed: np.linalg.solve(np.eye(n) - 0.85 * m, 0.15 * seed)
    start = np.where(good + bad > 0, 1.0, url_graph.PRIOR)
    want = np.stack([fixed(down.T, good) / fixed(down.T, start), fixed(up, bad) / fixed(up, start)], 1)
    ours = np.array([got[f"h{i}"] for i in range(n)])
    assert np.abs(ours - want).max() < url_graph.CLOSE and ours.min() >= 0 and ours.max() <= 1


def test_verdicts_of_linked_hosts(spark):
    """Hosts that link to blocked ones mostly are blocked; those that trusted ones link to, or that link to both, aren't."""
    link = lambda *hosts: " ".join(f"<a href='https://{h}/'>x</a>" for h in hosts)
    rows = [("http://x.net/es/1", ""), ("http://spam.org/", '<a href="http://x.net/a">'), ("http://ring.org/", link("spam.org", "x.net")), ("http://ok.org/", "<a href=/own>"), ("http://good.com/", "<A HREF = //both.org/>")]
    rows += [("http://both.org/", link("x.net", *(f"n{i}.info" for i in range(9)))), ("http://a.x.net/fr", ""), ("http://deep.a.x.net/de", "")] + [(f"http://n{i}.info/", link("both.org")) for i in range(9)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.host: r for r in url_graph.judge(pages).collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} >= {"x.net", "spam.org", "ring.org"}
    assert all(got[h].verdict == "allow" for h in ("ok.org", "good.com", "both.org", "n1.info")) and got["both.org"].trust > got["ok.org"].trust == 0
    assert got["deep.a.x.net"].distrust > 0
    assert url_graph.judge(pages.limit(0)).count() == 0


# --- 10 suffixes


def brute_suffixes(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "shared", "batch", "kinds"), [(40, 20, 30_000, 1_000), (40, 30, 20, 1_000), (40, 40, 10, 3), (100, 20, 50, 2)])
def test_dedup_equals_brute_force(spark, monkeypatch, request, length, shared, batch, kinds):
    if batch < 50:
        request.getfixturevalue("small_batches")
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", kinds)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, texts = [make(60), make(130), make(45)], []
    for _ in range(50):
        t = make(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(common)[rng.randint(0, 5) :] + make(rng.randint(0, 50))
        texts.append(t)
    texts += [texts[3], texts[4] * 2, "a" * 300, "ab" * 100, "", "x", None, "a" * 39, "a" * 40, "a" * 41, "é" * 60, "n\0l" * 20, "n\0l" * 15 + "\0" * 50]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tid string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(docs, length, shared).collect()}
    want = brute_suffixes([(t or "").encode() for t in texts], length)
    also = brute_suffixes([(t or "").encode() for t in texts], shared)
    assert got == {r[0]: (*w, x[1]) for r, w, x in zip(rows, want, also)} and sum(w[1] for w in want)
    cut = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, length).collect()}
    for r, w in zip(rows, want):
        if r[1] is not None and "é" not in r[1]:
            assert hashlib.sha256(cut[r[0]].encode()).hexdigest() == w[3]


def test_dedup_of_repeated_rows_and_one_repeating_text(spark):
    words = " ".join(words_of(400, 9))
    rows = [(1, words)] * 300 + [(2, words + " and an end of its own")] + [(3, "many times the same. " * 3000), (4, "x" + words[:450])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = Counter(tuple(r)[:5] for r in suffix_dedup.dedup(docs).collect())
    want = brute_suffixes([t.encode() for _, t in rows[:1] + rows[:1] + rows[300:]], 400)
    assert got == Counter({(1, *want[0]): 300, (2, *want[2]): 1, (3, *want[3]): 1, (4, *want[4]): 1})


def test_levels_find_all_and_stay_few():
    rng = np.random.default_rng(0)
    levels, seen = suffix_dedup.Levels(), []
    for _ in range(40):
        x = rng.integers(0, 600, rng.integers(1, 30)).astype(">u8")
        levels.add(x.view(np.uint8).reshape(-1, 8))
        seen.append(x)
        sizes = [len(k) for k, _ in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and all((k[1:] >= k[:-1]).all() for k, _ in levels.levels)
    everything = np.concatenate(seen)
    _, inverse, counts = np.unique(everything, return_inverse=True, return_counts=True)
    assert (levels.twice == (counts[inverse] > 1)).all()


def test_dedup_awkward(awkward, nothing):
    out = suffix_dedup.dedup(awkward).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out}
    assert by[6].n_removed == by[6].n_bytes == len(LONG) and by[0].n_bytes == 0 and by[7].n_removed == 0
    assert suffix_dedup.dedup(nothing).count() == suffix_dedup.without_repeats(nothing).count() == 0
    assert suffix_dedup.without_repeats(awkward).columns == awkward.columns


# --- shared pieces


def test_range_hashes():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    sums = rolling.prefix(rolling.TABLE[data])
    h = rolling.ranges(sums, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    start, end, own = rolling.tokens(*rolling.laid_out([b"ab cd", b"", b"ef\n g", None]))
    assert list(zip(start.tolist(), end.tolist(), own.tolist())) == [(0, 2, 0), (3, 5, 0), (5, 7, 2), (9, 10, 2)]
