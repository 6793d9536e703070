"""Operators with models: brute force on small inputs, held-out accuracy, odd rows, empty tables."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, decontaminate, grouping, images, language, near_dup, toxicity, words
from tidemark.runtime import table

WORDS = {lang: [f"{a}{b}" for a in first for b in second] for lang, first, second in (("xx", ["tor", "mal", "ken", "vi", "das"], ["ing", "ed", "er", "al", "un", "os"]), ("yy", ["été", "quo", "rue", "lâ", "bon"], ["que", "eau", "ière", "ment", "oi", "é"]))}


def prose(rng, n, lang="xx"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


# --- words -----------------------------------------------------------------------------------------------------------


def test_words_and_shingles_equal_plain_python():
    import re

    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 40), rng.choice(["xx", "yy"])) for _ in range(200)] + ["", "A a", "x" * 5000, "日本 日本", "one two three", None]
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode())
    names: dict = {}
    for row, block in [*words.blocks(pa.array(texts), limit=700), *words.blocks(pa.array(texts), limit=1)]:
        hashes, bounds, beginnings = words.word_hashes(block, (4, 6))
        shingles, at = words.shingle_hashes(hashes, bounds)
        for k in range(len(block)):
            own = split(texts[row + k])
            assert bounds[k + 1] - bounds[k] == len(own)
            for h, w in zip(hashes[bounds[k] : bounds[k + 1]].tolist(), own, strict=True):
                assert names.setdefault(("w", w), h) == h
            runs = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] or ([tuple(own)] if own else [])
            for h, s in zip(shingles[at[k] : at[k + 1]].tolist(), runs, strict=True):
                assert names.setdefault(("s", s), h) == h
        flat = [w for k in range(len(block)) for w in split(texts[row + k])]
        for n, (which, found) in zip((4, 6), beginnings, strict=True):
            assert which.tolist() == [i for i, w in enumerate(flat) if len(w) > n]
            for i, h in zip(which.tolist(), found.tolist(), strict=True):
                assert names.setdefault((n, flat[i][:n]), h) == h
    assert len(set(names.values())) == len(names)


# --- near duplicates -------------------------------------------------------------------------------------------------


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    sampler = near_dup.Sampler(600)
    universe = rng.integers(0, 2**63, 300).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        a, b = np.sort(universe[:200]), np.sort(np.concatenate([universe[: int(200 * share)], universe[200 : 400 - int(200 * share)]]))
        wa, wb = rng.uniform(0.5, 6, len(a)), rng.uniform(0.5, 6, len(b))
        common = np.isin(b, a)
        wb[common] = wa[np.searchsorted(a, b[common])] * rng.uniform(0.8, 1.25, common.sum())
        estimate = (sampler.draw(a, wa) == sampler.draw(b, wb)).mean()
        assert abs(estimate - near_dup.jaccard((a, wa), (b, wb))) < 0.08


def near_corpus(rng):
    rows, base = [], [prose(rng, 120).split() for _ in range(40)]
    for k, b in enumerate(base):
        rows.append((k, " ".join(b)))
        for c in range(rng.choice([0, 0, 1, 3])):
            edited = list(b)
            for _ in range(rng.choice([0, 1, 2, 6])):
                edited[rng.randrange(len(edited))] = f"edit{rng.random()}"
            rows.append((1000 + 10 * k + c, " ".join(edited)))
    return rows


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows = near_corpus(rng) + [(5000, None), (5001, ""), (5002, "  ... "), (5003, "two words"), (5004, "two words"), (None, "nameless text without a number"), (5005, "x " * 20_000)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "n", "r") for r in rows], "doc_id long, text string, node string, root string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    weights = near_dup.shingle_weights(df.select(F.coalesce("text", F.lit("")).alias("text")))
    texts = sorted({t or "" for _, t in rows})
    sets = list(near_dup.weighted_sets(pa.array(texts), weights))
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if near_dup.jaccard(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    place = {t: k for k, t in enumerate(texts)}
    smallest: dict = {}
    for d, t in rows:
        if d is not None:
            k = root(place[t or ""])
            smallest[k] = min(smallest.get(k, d), d)
    import hashlib

    group = {r["node"]: r["group_id"] for r in got}
    for t in texts:
        assert group[hashlib.md5(t.encode()).hexdigest()] == smallest.get(root(place[t]))
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({root(place[t or ""]) for _, t in rows})


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = random.Random(4)
    base = prose(rng, 200).split()
    rows = []
    for k in range(400):
        edited = list(base)
        if k:
            edited[rng.randrange(len(edited))] = f"edit{k}"
        rows.append((k, " ".join(edited)))
    rows += [(1000 + k, prose(rng, 60)) for k in range(50)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["group_id"] for r in got if r["doc_id"] < 1000} == {0}
    assert all(r["group_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


def test_near_copies_within_a_crowd_of_template_texts(spark):
    rng = random.Random(14)
    template, rows = [f"frame{k}" for k in range(200)], []
    for k in range(60):  # instances share the frame, and are 0.5 to 0.8 similar; each has a near copy
        own = [*template, *[f"own{k}x{w}" for w in range(26)]]
        edited = list(own)
        for at in (203, 208, 213, 218):
            edited[at] = f"edit{k}at{at}"
        rows += [(k, " ".join(own)), (1000 + k, " ".join(edited))]
    rows += [(5000 + k, prose(rng, 60)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = near_dup.shingle_weights(df.select("text"))
    sets = list(near_dup.weighted_sets(pa.array([t for _, t in rows[:120]]), weights))
    cross = [near_dup.jaccard(sets[i], sets[j]) for i in range(120) for j in range(i) if i // 2 != j // 2]
    assert 0.5 < min(cross) and max(cross) < 0.8 and all(near_dup.jaccard(sets[i], sets[i + 1]) >= 0.8 for i in range(0, 120, 2))
    got = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(df).collect()}
    assert [k for k in range(60) if got[k] != k or got[1000 + k] != k] == []


def test_block_similarities_equal_pair_by_pair(monkeypatch):
    rng = random.Random(17)
    weights = np.random.default_rng(17).uniform(0.5, 6, 1 << near_dup.DF_BITS).astype(np.float32)
    texts = [prose(rng, rng.choice([0, 3, 30, 31])) for _ in range(12)] + ["a b c d e " * 9, "a b c d e " * 4, ""]
    texts += [t + " tail" for t in texts]
    sets = list(near_dup.weighted_sets(pa.array(texts), weights))
    packed = []
    for items, own in near_dup.unit_items(pa.array(texts), weights):
        rows = np.empty(len(items), near_dup.ITEM)
        rows["item"], rows["weight"] = items, own
        packed.append(rows.tobytes())
    expected = np.array([[near_dup.jaccard(a, b) for b in sets[5:]] for a in sets])
    for cells in (near_dup.CELLS, 100):
        monkeypatch.setattr(near_dup, "CELLS", cells)
        assert np.allclose(near_dup.block_similarities(packed, packed[5:]), expected, atol=1e-6)
    pairs = [[near_dup.jaccard(near_dup._unpack(a), near_dup._unpack(b)) for b in packed[5:]] for a in packed]
    assert np.allclose(pairs, expected, atol=1e-6)


def test_spanning_links_join_what_the_pairs_join():
    rng = np.random.default_rng(18)
    for _ in range(50):
        roots, others = (rng.integers(0, 8, 12).astype(str).tolist() for _ in range(2))
        similar = rng.random((12, 12)) < 0.1

        def closed(pairs, roots=roots, others=others):
            parent = {r: r for r in (*roots, *others)}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, j in pairs:
                parent[root(roots[i])] = root(others[j])
            return {frozenset(x for x in parent if root(x) == r) for r in parent if root(r) == r}

        links = grouping.spanning_links(similar, roots, others)
        assert closed(links) == closed(np.argwhere(similar)) and len(links) < len({*roots, *others})


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (60, 80)):
        edges = [(f"{rng.randrange(n):03d}", f"{rng.randrange(n):03d}") for _ in range(m)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(25)]
        parent: dict = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        got = {r["node"]: r["root"] for r in grouping.components(spark, spark.createDataFrame(edges, "a string, b string")).collect()}
        assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_links_within_a_crowd_are_not_carried_along(spark, monkeypatch):
    crowd = [(a, b) for c in (0, 100) for a in range(c, c + 40) for b in range(c, a)] + [(500 + k, 501 + k) for k in range(20)]
    random.Random(3).shuffle(crowd)
    edges = spark.createDataFrame(crowd, "a long, b long")
    expected = {x: 0 if x < 100 else 100 if x < 500 else 500 for pair in crowd for x in pair}
    stars, _ = grouping.local_stars(spark, edges)
    assert stars.count() == len(expected) - 3
    assert {r["node"]: r["root"] for r in grouping.components(spark, edges).collect()} == expected
    monkeypatch.setattr(grouping, "EDGES_PER_TASK", 300)  # several parts, and so steps in Spark after them
    stars, parts = grouping.local_stars(spark, edges)
    assert parts > 3 and stars.count() < len(crowd)
    rows = grouping.components(spark, edges).collect()
    assert len(rows) == len(expected) and {r["node"]: r["root"] for r in rows} == expected


def test_a_crowd_is_joined_to_its_roots_by_node_and_not_by_bucket(spark, monkeypatch):
    from tidemark import runtime

    rows = [(0, key, node, 300 + 6 * (key == 0)) for key in range(40) for node in range(300 + 6 * (key == 0))]  # 306 nodes in bucket 0
    members = spark.createDataFrame(rows, "band int, key long, node long, n long")
    roots = spark.createDataFrame([(node, 0) for node in range(300)], "node long, root long")  # the other six are alone
    payload = spark.range(306).select(F.col("id").alias("node"), F.lit("x").alias("data"))
    made, persist = [], runtime.persist

    def joined(plan):
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() and "[node#" in plan.simpleString(25) else 0
        return own + sum(joined(plan.children().apply(k)) for k in range(plan.children().size()))

    def counted(spark, df, label):
        df.collect()
        made.append(joined(df._jdf.queryExecution().executedPlan()))
        return persist(spark, df, label)

    def compare(meeting):
        pairs = meeting.select("same", F.explode("members").alias("x"), "others").select("same", "x", F.explode("others").alias("y"))
        return pairs.where("x.root != y.root AND (NOT same OR x.node < y.node)").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    monkeypatch.setattr(runtime, "persist", counted)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = grouping.across_components(spark, members, roots, payload, compare, 5, 64, "test").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted((min(r), max(r)) for r in found) == sorted((a, b) for b in range(300, 306) for a in range(b))
    assert 306 <= sum(made) <= 3 * 306  # not the 12,006 rows of all buckets


# --- decontamination -------------------------------------------------------------------------------------------------


def test_lcs_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert decontaminate.lcs_length(a, b) == row[-1]


def test_answers():
    assert decontaminate.answer_of("What is it? Answer: forty two") == "forty two"
    assert decontaminate.answer_of("One. Two three. Four five.") == "Four five."
    assert decontaminate.answer_of("") == ""


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "ke", "lu") for b in ("n", "s", "v", "d", "p") for c in ("o", "i", "a", "um", "er", "ix", "yl", "op")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([14, 25, 40, 60, 150]))) for k in range(25)] + [(90, None), (91, "..."), (3, "again " + text(20))]
    docs, leaks = [], {}
    for d in range(400):
        body = text(rng.randrange(5, 400)).split()
        kind = d % 8
        if kind < 3:
            item, words_of = items[d % 25][0], items[d % 25][1].split()
            if kind == 1:  # a paraphrase: one word in eight replaced
                words_of = [w if rng.random() > 0.125 else rng.choice(vocabulary) for w in words_of]
            at = rng.randrange(len(body))
            body[at:at] = words_of
            leaks[d] = item
        docs.append((d, " ".join(body), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, items[0][1], "x"), (None, items[1][1].upper().replace(" ", ", "), "x")]
    leaks[1002] = 0
    return spark.createDataFrame(docs, "doc_id long, text string, tidemark string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_leaks_are_found_and_clean_documents_are_not(leaky):
    docs, items, leaks = leaky
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(docs, items).collect()}
    assert found[None] == [1] and found[1000] == [] == found[1001]
    exact = {d: i for d, i in leaks.items() if d % 8 != 1 or d == 1002}
    assert all(i in found[d] for d, i in exact.items())
    others = [d for d in leaks if d not in exact]
    assert sum(leaks[d] in found[d] for d in others) >= 0.9 * len(others)
    assert not [d for d in found if d is not None and d < 1000 and d not in leaks and found[d]]
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, x in found.items() if not x}


def test_candidates_have_recall(leaky):
    """Cosine search alone, against a window laid exactly over every planted item."""
    docs, items, leaks = leaky
    space = decontaminate.fit(docs)
    pieces = decontaminate.prepare_items([(r["item_id"], r["text"]) for r in items.orderBy("item_id").collect() if r["item_id"] < 25])
    searcher = decontaminate.Searcher(space, pieces)
    own = [decontaminate._bucket(np.array(w, np.uint64)) for w in pieces.words]
    placed = space.place(np.stack([space.vectors[w].sum(0) for w in own]))
    hit = [any((placed[j] @ vectors[list(ids).index(j)]) >= decontaminate.COSINE for _, ids, vectors, _, _ in searcher.blocks if j in ids) for j in range(len(own))]
    assert np.mean(hit) >= 0.9


def test_paraphrases_against_lcs_of_everything(spark):
    """Items of which 55 % to 70 % of the words are left, in order, the answer whole: brute force takes the LCS with the whole document."""
    rng = random.Random(19)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "ke", "lu", "zo") for b in ("n", "s", "v", "d", "p", "k") for c in ("o", "i", "a", "um", "er", "ix", "yl", "op")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{text(n - 6)}. {text(6)}.") for k, n in enumerate([16, 20, 23, 28, 32, 40, 47, 55, 60, 64] * 4)]
    docs, expected = [], []
    for d in range(600):
        body = text(rng.randrange(30, 300)).split()
        if d % 3 == 0:
            item, words_of = items[d // 3 % len(items)][0], items[d // 3 % len(items)][1].split()
            lost = rng.sample(range(len(words_of) - 6), min(int((0.3 + 0.14 * rng.random()) * len(words_of)), len(words_of) - 6))
            words_of = [rng.choice(vocabulary) if k in lost else w for k, w in enumerate(words_of)]
            at = rng.randrange(len(body))
            body[at:at] = words_of
            expected.append((d, item))
        docs.append((d, " ".join(body)))
    split = lambda t: words.word_hashes(pa.array([t]))[0].tolist()
    by_id, item_words = dict(docs), {k: split(t) for k, t in items}
    whole = [(d, k) for d, k in expected if decontaminate.lcs_length(item_words[k], split(by_id[d])) >= decontaminate.LCS_PARAPHRASE * len(item_words[k])]
    found = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(whole) > 150 and np.mean([k in found[d] for d, k in whole]) >= 0.9
    assert not [d for d in found if d % 3 and found[d]]


def test_fit_takes_a_text_once(spark):
    rng = random.Random(20)
    rows = [("one text that stands on very many rows of all",)] * 3000 + [(prose(rng, 80),) for _ in range(300)]
    many = decontaminate.fit(spark.createDataFrame(rows, "text string"), fit_rows=1000)
    once = decontaminate.fit(spark.createDataFrame(rows[2999:], "text string"), fit_rows=1000)
    cosine = lambda a, b: (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-9)
    assert many.vectors.shape == once.vectors.shape and np.isfinite(many.turn).all() and np.isfinite(cosine(many.vectors, once.vectors)).all()


def test_fit_takes_all_texts(spark):
    """Mean and IDF against brute force over more texts than a sample of round 2 took."""
    rng = random.Random(21)
    texts = [f"{prose(rng, 9)} w{k}" for k in range(20_000)] + ["copied line"] * 500
    space = decontaminate.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    hashes, bounds = words.word_hashes(pa.array(texts))
    of, word = np.repeat(np.arange(len(texts)), np.diff(bounds)), decontaminate._bucket(hashes)
    df = np.bincount(np.unique(of * decontaminate.BUCKETS + word) % decontaminate.BUCKETS, minlength=decontaminate.BUCKETS)
    assert np.allclose(space.idf, np.log((len(texts) + 1) / (df + 1)), atol=1e-5)
    v = np.add.reduceat(space.vectors[word], bounds[:-1], axis=0)[:20_001].astype(np.float64)
    assert np.allclose(space.mean, (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).mean(0), atol=2e-5)


def test_projection_equals_a_dense_product_for_less():
    import time

    rng = np.random.default_rng(12)
    rows = [np.concatenate([rng.integers(0, decontaminate.BUCKETS, n), rng.integers(0, 40, n // 4)]).astype("<u2") for n in [1, 5, 64, *rng.integers(1, 400, 400).tolist()]]
    batch = pa.record_batch([pa.array([r.tobytes() for r in rows], pa.binary())], names=["words"])
    idf = rng.uniform(0.5, 8, decontaminate.BUCKETS).astype(np.float32)
    shared = type("Shared", (), {"value": idf})
    test = decontaminate._test_matrix()

    def dense():
        total = np.zeros(test.shape)
        for of, word, counts, n in decontaminate._passages(iter([batch])):
            used, column = np.unique(word, return_inverse=True)
            x = np.zeros((n, len(used)), np.float32)
            x[of, column] = (1 + np.log(counts)) * idf[word]
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
            total[used] += x.T @ (x @ test[used])
        return total

    def fastest(run):
        spent = []
        for _ in range(5):
            begun = time.process_time()
            out = run()
            spent.append(time.process_time() - begun)
        return out, min(spent)

    expected, plain = fastest(dense)
    found, own = fastest(lambda: pa.Table.from_batches(decontaminate._project(shared)(iter([batch]))))
    total = np.zeros(test.shape)
    total[found["cell"].to_numpy()] = np.stack([c.to_numpy() for c in found.columns[1:]], 1) / 2**24
    assert np.abs(total - expected).max() < 1e-5 * np.abs(expected).max()
    assert own < 0.75 * plain


def test_word_hashes_equal_their_definition():
    """Sums of powers of the base, whatever stands before a word; words longer than what is handled at a time, and prefixes, among them."""
    rng = random.Random(31)
    odd = ["", "a", " ", "..a", "A" * 70_000, "x " * 40_000 + "Y" * 40_000 + " z", "é" * 20_000, "a", "b", "." * 50_000]
    odd += ["".join(rng.choice("ab .É中0-") for _ in range(rng.randrange(12))) for _ in range(300)]
    base, expected, starts = int(words._BASE), [], {2: [], 5: []}
    power = np.cumprod(np.full(70_000, base, np.uint64))
    plain = lambda part: np.sum(power[: len(part)] * (np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)), dtype=np.uint64)
    for text in odd:
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
            expected.append(plain(word) + np.uint64(len(word)))
            for n in starts:
                if len(word) > n:
                    starts[n].append((len(expected) - 1, plain(word[:n]) ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1)))
    hashes, bounds, longer = words.word_hashes(pa.array(odd), (2, 5))
    assert (hashes == words.mix64(np.array(expected, np.uint64))).all() and bounds[-1] == len(expected)
    for (at, found), own in zip(longer, starts.values()):
        assert at.tolist() == [k for k, _ in own] and (found == words.mix64(np.array([h for _, h in own], np.uint64))).all()


def test_projection_in_several_parts(monkeypatch):
    """Entries that are added in parts, of more and fewer rows than are gathered at a time, give the dense product."""
    rng = np.random.default_rng(13)
    sizes = [(1, 3), (40, 300), (7, 0), (90, 900), (200, 20)]
    for entries, at_once in [(1, 1), (400, 7), (1 << 21, 1 << 13)]:
        monkeypatch.setattr(decontaminate, "ENTRIES", entries)
        monkeypatch.setattr(decontaminate, "ENTRIES_AT_ONCE", at_once)
        total, expected = np.zeros((decontaminate.BUCKETS, 5)), np.zeros((decontaminate.BUCKETS, 5))
        transposed = decontaminate._Transposed(total)
        for n, m in sizes:
            of, word = np.sort(rng.integers(0, n, m)), rng.choice([0, 1, 2, 500, decontaminate.BUCKETS - 1], m)
            values, low = rng.random(m).astype(np.float32), rng.standard_normal((n, 5)).astype(np.float32)
            np.add.at(expected, word, low[of].astype(np.float64) * values[:, None])
            transposed.add(of, word, values, low)
        transposed.flush()
        assert np.abs(total - expected).max() < 1e-4


def test_windows_that_share_too_little_get_no_vector():
    """All windows get one where the bounds are taken away; hits are the same, of pieces of all classes and of one whose words stand everywhere."""
    rng = random.Random(29)
    text = lambda n: " ".join(f"w{int(20_000 * rng.random() ** 3) + 1}" for _ in range(n))
    rows = [(k, f"{text(n - 6)}. {text(6)}.") for k, n in enumerate([16, 20, 23, 28, 40, 47, 60, 64, 150] * 12)]
    texts = [text(rng.choice([3, 9, 30, 100, 700])) for _ in range(600)] + ["", None, "w1"]
    for d in range(0, 600, 5):
        body, words_of = texts[d].split(), rows[d // 5 % len(rows)][1].split()
        at = rng.randrange(len(body))
        body[at:at] = [w if rng.random() > 0.2 else "other" for w in words_of]
        texts[d] = " ".join(body)
    texts = pa.array(texts)
    hashes, bounds = words.word_hashes(texts.fill_null(""))
    of, word = np.repeat(np.arange(len(texts)), np.diff(bounds)), decontaminate._bucket(hashes)
    df = np.bincount(np.unique(of * decontaminate.BUCKETS + word) % decontaminate.BUCKETS, minlength=decontaminate.BUCKETS)
    idf = np.log((len(texts) + 1) / (df + 1)).astype(np.float32)
    idf[decontaminate._bucket(words.word_hashes(pa.array(["w1 w2"]))[0])] = 0
    vectors = np.random.default_rng(3).standard_normal((decontaminate.BUCKETS, 24)).astype(np.float32) * idf[:, None]
    placed = []

    class Space(decontaminate.Space):
        def place(self, sums):
            placed[-1] += len(sums)
            return super().place(sums)

    space = Space(idf, vectors, np.full(24, 0.05, np.float32), np.eye(24, dtype=np.float32))
    for more in ([], [(500, "w1 w2 w1 w1 w2 w1 w1")]):
        placed.append(0)
        searcher = decontaminate.Searcher(space, decontaminate.prepare_items(rows + more))
        placed[-1] = 0
        found = searcher.search(texts)
        searcher.bounds = [None] * len(searcher.blocks)
        placed.append(0)
        assert found == searcher.search(texts)
        assert sum(map(len, found)) >= 100
    windows = sum(max(-(-n // (c // 4)) - 3, 1) for n in np.diff(bounds).tolist() if n for c in decontaminate.CLASSES)
    assert placed[0] < 0.3 * windows <= 0.3 * placed[1]


def test_decontamination_of_odd_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    long = "filler " * 60_000 + item + " filler" * 60_000
    rng = random.Random(23)
    rows = [(1, long), (2, item), (2, item), (3, None), (4, "alpha"), (None, item.upper())]
    docs = spark.createDataFrame(rows + [(100 + k, prose(rng, 100)) for k in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (None, item), (9, "")], "item_id long, text string")
    found = sorted(((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in decontaminate.find_leaks(docs, items).where("doc_id IS NULL OR doc_id < 100").collect()), key=repr)
    assert found == sorted([(1, [7, 8, None]), (2, [7, 8, None]), (2, [7, 8, None]), (3, []), (4, []), (None, [7, 8, None])], key=repr)


def test_decontamination_of_nothing(spark):
    empty, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 2


# --- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    bad = ["grobbel", "grobbing", "snarfle", "zibzab", "zibzorn", "idiot"]
    docs, labels = [], []
    for d in range(1500):
        toxic = rng.random() < 0.15
        body = prose(rng, rng.randrange(3, 120), rng.choice(["xx", "yy"])).split()
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                body.insert(rng.randrange(len(body) + 1), rng.choice(bad))
        docs.append((d, " ".join(body), d, 0.5))
        labels.append((d, int(toxic != (rng.random() < 0.02))))
    truth = {d: any(b in t for b in bad) for d, t, _, _ in docs}
    return spark.createDataFrame(docs, "doc_id long, text string, predicted long, Score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_held_out_toxicity(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels.where(~language.held_out()))
    rows = toxicity.score(docs, model).withColumn("out", language.held_out()).where("out").collect()
    assert len(rows) > 400
    recall = np.mean([r["predicted"] for r in rows if truth[r["doc_id"]]])
    false = np.mean([r["predicted"] for r in rows if not truth[r["doc_id"]]])
    assert recall > 0.9 and false < 0.02
    again = toxicity.train(docs.repartition(7), labels.where(~language.held_out()).repartition(3))
    assert np.allclose(model.weights, again.weights) and model.offset == pytest.approx(again.offset)


def test_the_label_model_weighs_down_copied_voters():
    rng = np.random.default_rng(10)
    y = rng.random(4000) < 0.3
    vote = lambda accuracy: np.where(rng.random(len(y)) < accuracy, y, ~y) * 2.0 - 1
    poor = vote(0.6)
    voters = np.column_stack([vote(0.85), vote(0.8), vote(0.85), *[poor] * 8, vote(0.9)])
    posterior = toxicity.label_model(voters)
    majority = voters.sum(1) > 0
    assert ((posterior > 0.5) == y).mean() > 0.88 > (majority == y).mean() + 0.15


def test_tails_equal_sums_of_binomials():
    from math import comb

    a, n, p = np.array([0, 3, 5, 5, 40, 300, 2]), np.array([4, 3, 50, 50, 90, 900, 1000]), 0.13
    expected = [sum(comb(int(m), k) * p**k * (1 - p) ** (int(m) - k) for k in range(int(x), int(m) + 1)) for x, m in zip(a, n, strict=True)]
    assert np.allclose(toxicity.tails(a, n, p), expected, rtol=1e-6)


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More rows than a sample of round 2 took; rows counted once with their number give what single rows give."""
    rng = random.Random(12)
    rows = [(k, f"w{k} " + prose(rng, 8), int(k % 1000 == 0)) for k in range(32_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    taken = toxicity.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert taken.count() > 31_900 and taken.where("toxic = 1").count() == 32
    votes = np.array([[rng.choice([-1, 0, 1]) for _ in range(3)] for _ in range(6)], np.float64)
    votes[:3, 2], votes[3:, 2] = 1, -1
    times = np.array([4, 1, 3, 5, 2, 7])
    y = toxicity.label_model(votes, times=times.astype(np.float64))
    assert np.allclose(np.repeat(y, times), toxicity.label_model(np.repeat(votes, times, axis=0)))
    hits = [np.flatnonzero(v > 0) for v in votes]
    one = toxicity.fit_linear(hits, y, 3, times=times.astype(np.float64))
    each = toxicity.fit_linear([h for h, n in zip(hits, times, strict=True) for _ in range(n)], np.repeat(y, times), 3)
    assert np.allclose(one[0], each[0]) and np.isclose(one[1], each[1])
    for a, n in ((60_300, 500_000), (59_000, 500_000), (300, 1_000), (5, 3_000)):
        whole = sum(np.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * np.log(0.12) + (n - k) * np.log(0.88)) for k in range(a, min(n, a + 40_000) + 1))
        assert np.isclose(toxicity.tails(np.array([a]), np.array([n]), 0.12)[0], whole, rtol=1e-6)


def test_label_model_and_regression_equal_plain_python():
    """The same estimates, written as loops over rows and voters."""
    from math import exp, log

    rng = np.random.default_rng(25)
    truth = rng.random(60) < 0.4
    votes = np.column_stack([np.where(rng.random(60) < 0.2, 0, np.where(rng.random(60) < q, truth, ~truth) * 2 - 1) for q in (0.9, 0.8, 0.6)] + [truth * 2 - 1]).astype(float)
    n, m = votes.shape
    y = [0.95 if votes[i][-1] > 0 else 0.05 for i in range(n)]
    for _ in range(4):
        ones = sum(y)
        table = {(j, v): log((sum(y[i] for i in range(n) if votes[i][j] == v) + 0.5) / (ones + 1.5)) - log((sum(1 - y[i] for i in range(n) if votes[i][j] == v) + 0.5) / (n - ones + 1.5)) for j in range(m) for v in (-1, 0, 1)}
        r = [[table[j, votes[i][j]] for j in range(m)] for i in range(n)]
        mean = [[sum((1 - y[i] if c == 0 else y[i]) * r[i][j] for i in range(n)) / (n - ones if c == 0 else ones) for j in range(m)] for c in (0, 1)]
        spread = np.array([[sum((1 - y[i]) * (r[i][j] - mean[0][j]) * (r[i][k] - mean[0][k]) + y[i] * (r[i][j] - mean[1][j]) * (r[i][k] - mean[1][k]) for i in range(n)) / n for k in range(m)] for j in range(m)])
        w = np.clip(np.linalg.inv(spread + np.diag([0.05 * spread[j][j] + 0.05 for j in range(m)])) @ (np.array(mean[1]) - np.array(mean[0])), 0, 1)
        y = [1 / (1 + exp(-max(-30, min(30, sum(w[j] * r[i][j] for j in range(m)) + log((ones / n) / (1 - ones / n)))))) for i in range(n)]
    assert np.allclose(toxicity.label_model(votes, rounds=4), y)

    hits = [np.flatnonzero(rng.random(4) < 0.4) for _ in range(60)]
    x = np.zeros((60, 5))
    for i, h in enumerate(hits):
        x[i, h] = 1
    x[:, 4] = 1
    theta = np.array([0.0, 0, 0, 0, -2])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-x @ theta))
        decay = np.array([3e-3] * 4 + [0])
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 60 + np.diag(decay + 1e-12), x.T @ (p - np.array(y)) / 60 + decay * theta)
    weights, offset = toxicity.fit_linear(hits, np.array(y), 4, steps=4000, decay=3e-3)
    assert np.allclose([*weights, offset], theta, atol=2e-2)


def test_repeated_training_rows_and_long_texts(spark, labelled):
    docs, labels, truth = labelled
    long = spark.createDataFrame([(9000, "zibzab " + "word " * 100_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").where("doc_id < 300")).unionByName(long)
    labels = labels.unionByName(labels.where("doc_id < 500")).unionByName(spark.createDataFrame([(9000, 1), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).where("doc_id < 9000").collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_toxicity_of_odd_rows_and_without_labels(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zibzab " * 30_000), (4, "fine"), (4, "fine"), (None, "x")], "doc_id long, text string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows) and rows[2]["predicted"] == 1 and rows[0]["predicted"] == 0
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        assert {r["predicted"] for r in toxicity.score(odd, toxicity.train(docs, some)).collect()} == {0}
    assert toxicity.score(odd.limit(0), model).count() == 0


# --- languages -------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    rows = language.identify(docs.withColumn("Score", F.lit("old")), *model).withColumn("out", language.held_out()).where("out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_equal_plain_python():
    texts = ["Ab, c!", "", "ÉÉ", "1234", "a\n\nb", "日本"]
    grams, of, has = language.ngrams(pa.array(texts))
    assert has.tolist() == [True, False, True, False, True, True]
    for k, t in enumerate(texts):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        kept = "".join(c for i, c in enumerate(letters) if c != " " or (i and letters[i - 1] != " "))
        assert (of == k).sum() == sum(max(len(kept) - n + 1, 0) for n in (1, 2, 3)), t
    alone = language.ngrams(pa.array(texts[:1]))[0]
    assert np.array_equal(np.sort(alone), np.sort(grams[of == 0]))


def test_bayes_equals_plain_python(spark):
    """Training and prediction with a dictionary of counts, text by text."""
    from math import exp, log

    rng = random.Random(26)
    rows = [(k, prose(rng, rng.randrange(1, 30), lang), lang) for k, lang in enumerate(["xx", "yy", "yy"] * 15)] + [(90, None, "xx"), (91, "12 !", "xx"), (92, "torer été", None)]
    rows += rows[:5] + [(93, "toring " * 20_000, "xx")]
    buckets = 512
    counts = {lang: [0.1] * buckets for lang in ("xx", "yy")}
    for _, text, lang in rows:
        if text and lang:
            for g in language.ngrams(pa.array([text]), buckets)[0].tolist():
                counts[lang][g] += 1
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=buckets)
    texts = [t for _, t, _ in rows] + ["torkened viun", "bonque", "zzz"]
    for text, got in zip(texts, language.predict(pa.array(texts), *model).to_pylist(), strict=True):
        grams = language.ngrams(pa.array([text or ""]), buckets)[0].tolist()
        sums = {lang: sum(log(c[g] / sum(c)) for g in grams) for lang, c in counts.items()} if len(grams) < 2000 else None
        if not grams:
            assert got == {"lang_pred": "und", "score": 0.0}
        elif sums is not None:
            best = max(sorted(sums), key=sums.get)
            assert got["lang_pred"] == best and abs(got["score"] - 1 / sum(exp((s - sums[best]) / len(grams) ** 0.5) for s in sums.values())) < 1e-3
        else:
            assert got["lang_pred"] == "xx"
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.range(language.MAX_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang")))


def test_language_of_odd_rows(spark):
    rows = [(k, prose(random.Random(k), 20, lang), lang) for k, lang in enumerate(["xx", "yy"] * 20)] + [(100, None, "xx"), (101, "123 !!", None), (102, "", "zz"), (None, "torer maler", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, *model).collect()}
    assert (got[100], got[101], got[102], got[None]) == ("und", "und", "und", "xx") and got[0] == "xx" and got[1] == "yy"
    assert {r["lang_pred"] for r in language.identify(df, *language.train(df.limit(0))).collect()} == {"und"}
    few = language.train(df, train_rows=10)
    assert few[0] == model[0] and language.identify(df.limit(0), *few).count() == 0


def test_a_rare_language_is_learned_from_many_rows(spark):
    rare = spark.createDataFrame([(-k, "wabbo zukko " + prose(random.Random(k), 2, "yy"), "rare") for k in range(1, 4)], "doc_id long, text string, lang string")
    many = spark.range(400_000).select(F.col("id").alias("doc_id"), F.expr("concat('toring maled ', id % 7)").alias("text"), F.lit("xx").alias("lang"))
    bare = spark.createDataFrame([(-9, "123", "bare")], "doc_id long, text string, lang string")
    for bound in ({}, {"train_rows": 5_000}):
        model = language.train(rare.unionByName(many).unionByName(bare), **bound)
        assert {r["lang_pred"] for r in language.identify(rare, *model).collect()} == {"rare"}
        assert model[0] == ["rare", "xx"]


# --- images ----------------------------------------------------------------------------------------------------------


def test_crops_and_edits_are_found(spark):
    rng = np.random.default_rng(11)
    base = [np.kron(rng.integers(0, 255, (16, 16)), np.ones((9, 9))).astype(np.uint8) for _ in range(20)]
    rows = [(k, images.write_pgm(b)) for k, b in enumerate(base)]
    rows += [(100 + k, images.write_pgm(b[10:120, 14:132])) for k, b in enumerate(base)]
    rows += [(200 + k, images.write_pgm(np.clip(b * 0.7 + 20 + rng.normal(0, 3, b.shape), 0, 255).astype(np.uint8))) for k, b in enumerate(base)]
    rows += [(300, rows[0][1]), (400, None), (401, None), (402, b""), (403, b"P5 9 9 255\nshort"), (404, images.write_pgm(np.zeros((50, 50)))), (405, images.write_pgm(np.zeros((60, 50)))), (None, rows[1][1])]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d), "n") for i, d in rows], "image_id long, image binary, node string")
    got = {r["image_id"]: r["group_id"] for r in images.image_copies(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[100 + k] == k for k in range(20)) >= 18 and all(got[200 + k] == k for k in range(20))
    assert all(got[k] == k for k in [*range(20), 400, 401, 402, 403, 404, 405]) and got[300] == 0 and got[None] == 1
    assert images.image_copies(df.limit(0)).count() == 0


def warp(p, s, degrees):
    (h, w), t = p.shape, np.deg2rad(degrees)
    y, x = np.mgrid[: int(h * s), : int(w * s)]
    y, x = (y + 0.5) / s - h / 2, (x + 0.5) / s - w / 2
    at_y = np.clip(np.cos(t) * y + np.sin(t) * x + h / 2 - 0.5, 0, h - 1.001)
    at_x = np.clip(-np.sin(t) * y + np.cos(t) * x + w / 2 - 0.5, 0, w - 1.001)
    i, j = at_y.astype(int), at_x.astype(int)
    u, v, a = at_y - i, at_x - j, p.astype(float)
    return a[i, j] * (1 - u) * (1 - v) + a[i + 1, j] * u * (1 - v) + a[i, j + 1] * (1 - u) * v + a[i + 1, j + 1] * u * v


def texture(rng, side=120):
    a = images._box(images._box(rng.normal(size=(side, side)), 1), 2)
    return (a - a.min()) / (a.max() - a.min()) * 255


def similar_pairs(rows):
    """Brute force: consensus of all pairs of images."""
    points = images.describe_all([d for _, d in rows])
    return [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if images.consensus(points[i], points[j]) >= images.THRESHOLD]


def image_groups(spark, rows):
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "image_id long, image binary")
    return {r["image_id"]: r["group_id"] for r in images.image_copies(df).collect()}


def test_descriptors_turn_with_the_image():
    rng = np.random.default_rng(16)
    for p in (texture(rng), images.render(rng.normal(size=64))):
        points = images.describe(p[None])[0]
        for quarter in (1, 2, 3):
            turned = images.describe(np.rot90(p, quarter)[None])[0]
            distance = np.bitwise_count(points["bits"][:, None] ^ turned["bits"][None]).sum(2)
            assert np.median(distance.min(1)) <= 2 and images.consensus(points, turned) > 0.8


def test_edited_copies_of_textures_are_found(spark):
    rng = np.random.default_rng(15)
    base = [texture(rng) for _ in range(12)]
    edits = [
        lambda p: np.rot90(p), lambda p: np.rot90(p, 2), lambda p: np.rot90(p, 3), lambda p: warp(p, 1, 20), lambda p: warp(p, 1, -7), lambda p: warp(p, 0.95, 0), lambda p: warp(p, 0.75, 0),
        lambda p: p[24:, :96], lambda p: p[14:106, 14:106], lambda p: np.clip(p + rng.normal(0, 8, p.shape), 0, 255), lambda p: p // 16 * 16 + 8, lambda p: images._box(p, 1), lambda p: p * 0.7 + 20,
    ]
    rows = [(k, images.write_pgm(p)) for k, p in enumerate(base)] + [(100 * (e + 1) + k, images.write_pgm(edit(p))) for e, edit in enumerate(edits) for k, p in enumerate(base)]
    got = image_groups(spark, rows)
    for e in range(len(edits)):
        assert np.mean([got[100 * (e + 1) + k] == k for k in range(12)]) >= 0.9, e
    assert len({got[k] for k in range(12)}) == 12


def test_groups_of_tiles_against_brute_force(spark):
    """Tiles and their edited copies: all pairs by consensus, and the groups they make, against the buckets'."""
    rng = np.random.default_rng(15)
    base = [images.render(rng.normal(size=64)) for _ in range(30)]
    edits = [lambda p: warp(p, 0.95, 0), lambda p: warp(p, 1, 3), lambda p: np.clip(p + rng.normal(0, 8, p.shape), 0, 255), lambda p: p // 16 * 16 + 8, lambda p: images._box(p.astype(float), 1), lambda p: np.rot90(p)]
    rows = [(k, images.write_pgm(p)) for k, p in enumerate(base)] + [(100 * (e + 1) + k, images.write_pgm(edit(p))) for e, edit in enumerate(edits) for k, p in enumerate(base)]
    pairs = similar_pairs(rows)
    got = image_groups(spark, rows)
    assert len(pairs) > 200 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
    parent = {i: i for i, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[root(a)] = root(b)
    assert all(root(i) == root(g) for i, g in got.items())


def test_crowded_buckets_lose_no_pair(spark):
    """Many images that share a corner, and pairs of copies among them: leaders alone do not see these."""
    rng = np.random.default_rng(21)
    shared = texture(rng, 60)
    rows = []
    for k in range(40):
        p = np.concatenate([np.concatenate([shared, texture(rng, 60)], 1), np.concatenate([texture(rng, 60), texture(rng, 60)], 1)])
        rows += [(k, images.write_pgm(p)), (1000 + k, images.write_pgm(np.clip(p + rng.normal(0, 4, p.shape), 0, 255)))]
    threshold = 0.6
    points = dict(zip([i for i, _ in rows], images.describe_all([d for _, d in rows]), strict=True))
    assert all(images.consensus(points[k], points[1000 + k]) >= threshold for k in range(40))
    assert max(images.consensus(points[k], points[m]) for k in range(40) for m in range(k)) < threshold
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "image_id long, image binary")
    got = {r["image_id"]: r["group_id"] for r in images.image_copies(df, threshold).collect()}
    assert all(got[1000 + k] == got[k] == k for k in range(40))


def test_a_crowd_of_near_copies_meets_its_leaders_in_few_rows(spark, monkeypatch):
    from tidemark import runtime

    rng = np.random.default_rng(24)
    centre = rng.normal(size=64)
    rows = [(k, images.write_pgm(images.render(centre + rng.normal(0, 0.09, 64)))) for k in range(150)] + [(1000 + k, images.write_pgm(images.render(rng.normal(size=64)))) for k in range(20)]
    made, persist = [], runtime.persist

    def joined(plan):
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() and "leader_order" in plan.simpleString(25) else 0
        return own + sum(joined(plan.children().apply(k)) for k in range(plan.children().size()))

    def counted(spark, df, label):
        if label == "image-pairs":
            df.collect()
            made.append(joined(df._jdf.queryExecution().executedPlan()))
        return persist(spark, df, label)

    monkeypatch.setattr(runtime, "persist", counted)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = image_groups(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert 149 <= sum(made) <= 30 * 150
    assert len(got) == 170 and {got[k] for k in range(150)} == {0}


def test_only_buckets_of_several_roots_stay(spark):
    banded = spark.createDataFrame([(0, key, node, root) for key, nodes in ((1, [(1, 1), (2, 1), (3, 1)]), (2, [(1, 1), (2, 1), (4, 4)]), (3, [(5, 5)])) for node, root in nodes], "band int, key long, node long, root long")
    members = grouping.meeting_rows(banded)
    assert sorted((r["key"], r["node"], r["root"], r["n"]) for r in members.collect()) == [(2, 1, 1, 3), (2, 2, 1, 3), (2, 4, 4, 3)]
    pairs, _ = grouping.leader_pairs(spark, members, 4, "test")
    assert sorted(tuple(sorted(r)) for r in pairs.collect()) == [(1, 4), (2, 4)]


def test_matches_of_many_pairs_equal_those_of_each():
    rng = np.random.default_rng(22)
    points = images.describe_all([images.write_pgm(p) for p in [texture(rng, 60) for _ in range(6)] + [images.render(rng.normal(size=64)) for _ in range(20)]] + [b""])
    points += [p[::2] for p in points]
    left = [points[i] for i in range(len(points)) for _ in points]
    right = [p for _ in points for p in points]
    assert images.similarities(left, right).tolist() == [images.consensus(a, b) for a, b in zip(left, right, strict=True)]


def test_consensus_of_other_images_is_zero():
    rng = np.random.default_rng(12)
    points = images.describe(np.stack([images.render(rng.normal(size=64)) for _ in range(60)]))
    assert max(images.consensus(a, b) for i, a in enumerate(points) for b in points[:i]) < images.THRESHOLD
    assert all(images.consensus(p, p) == 1 for p in points if len(p) >= images.MIN_INLIERS)


def test_vectors_as_images(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    got = {r["image_id"]: images.read_pgm(r["image"]) for r in images.render_vectors(df).collect()}
    assert got[1].shape == (12, 12) and got[1].max() == 255 and got[2] is None and got[3].shape == (6, 6)


# --- the registered queries --------------------------------------------------------------------------------------------

CONTRACT = {
    "op2_chat_formatting": ("conversations", "conv_id", {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}),
    "op3_warc_revisits": ("pages", "page_id", {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}),
    "op4_toxicity": ("documents", "doc_id", {"doc_id", "held_out", "score", "predicted"}),
    "op5_image_copies": ("embeddings", "vec_id", {"vec_id", "image_class", "group_id"}),
    "op6_language_id": ("documents", "doc_id", {"doc_id", "held_out", "lang_pred", "score"}),
    "op7_secret_scan": ("documents", "doc_id", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    "op8_mixing": ("documents", "doc_id", {"doc_id", "size", "source_size", "target", "taken"}),
    "op9_url_filter": ("pages", "page_id", {"page_id", "host", "path", "rule", "verdict"}),
    "op10_near_dup": ("documents", "doc_id", {"doc_id", "text_class", "group_id"}),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query_answers_for_every_row(spark, sf_dir, name):
    source, key, columns = CONTRACT[name]
    got = catalog.queries()[name](spark, sf_dir)
    assert columns <= set(got.columns)
    ids = sorted(r[0] for r in table(spark, sf_dir, source).select(key).collect())
    assert sorted(r[key] for r in got.select(key).collect()) == (sorted({*ids, -7}) if name.startswith("op2") else ids)


def test_registered_scores_keep_their_contracts(spark, sf_dir):
    import zlib

    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    for r in catalog.queries()["op4_toxicity"](spark, sf_dir).collect():
        assert r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert labels
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    rows = catalog.queries()["op6_language_id"](spark, sf_dir).collect()
    assert all(r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]) > 0.95


def test_registered_decontamination_against_brute_force(spark, sf_dir):
    """Every document and item: the six-word runs that they share, and LCS of whole texts."""
    split = lambda t: words.word_hashes(pa.array([t or ""]))[0].tolist()
    runs = lambda w: {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
    items = {r["item_id"]: split(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()}
    texts = {r["doc_id"]: split(r["text"]) for r in table(spark, sf_dir, "documents").collect()}
    of_item = {k: runs(w) for k, w in items.items()}
    planted = set()
    for d, w in texts.items():
        own = runs(w)
        planted |= {(d, k) for k, r in of_item.items() if r and len(own & r) >= 0.5 * len(r)}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.queries()["op1_decontamination"](spark, sf_dir).collect()}
    assert planted and planted <= got
    assert all(decontaminate.lcs_length(items[k], texts[d]) >= decontaminate.LCS_PARAPHRASE * len(items[k]) for d, k in got)


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit("mine"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        counts.append(out.count())
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] > 0.6 * counts[0]
    assert docs.where(F.regexp_like("text", F.lit("[0-9a-f]{24}"))).count() == 0
    assert docs.where("copy > repeats OR copy < 1 OR copy > 2").count() == 0
    by_source = docs.groupBy("source").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).collect()
    assert abs(sum(r["words"] for r in by_source) - 1.5 * sum(r["source_size"] for r in by_source)) < 0.1 * sum(r["source_size"] for r in by_source)
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_pipeline_stages_with_odd_rows(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(k if k % 9 else None, None if k % 7 == 0 else prose(rng, rng.choice([0, 1, 3, 30])), None if k % 5 == 0 else "xx", None if k % 4 == 0 else f"s{k % 3}", None if k % 3 == 0 else k, "e") for k in range(60)]
    rows += rows[:10] + [(500, "long " * 50_000, "xx", "s1", 1, "e"), (501, "", "xx", "s1", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").withColumns({"node": F.lit(1), "predicted": F.lit("p"), "target_": F.lit(2)})
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf_dir).cache()
            assert (out.count() > 0) == (given is docs)
            if name != "mixing":
                assert out.columns == docs.columns
            if name == "near_dedup" and given is docs:
                assert out.where("text IS NULL OR text = ''").count() == 1 and out.where("doc_id = 500").count() == 1
