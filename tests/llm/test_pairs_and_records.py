import random
import re
from collections import defaultdict

import numpy as np

from tessera.llm import components, neighbours, ngram_join, warc
from tests.llm.conftest import prose


def brute_join(rows, n=5, percent=75):
    """Set sizes and smallest ids of components of (doc_id, text) rows with distinct ids."""
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(dice, groups=12, size=9):
    rows, passage = [], prose(dice, 60)
    for _ in range(groups):
        words = prose(dice, dice.choice((8, 60, 200))).split()
        for _ in range(size):
            own = list(words)
            for _ in range(dice.randrange(max(2, len(words) // 25))):
                own[dice.randrange(len(own))] = f"new{dice.randrange(10**6)}"
            rows.append(" ".join(own) + (" " + passage if dice.random() < 0.5 else ""))
    rows += [rows[0]] * 5 + [rows[3].upper(), "", None, "a b", "a b", "A  B", " ".join(["same"] * 50), " ".join(["same"] * 70)]
    dice.shuffle(rows)
    return list(enumerate(rows))


def test_join_matches_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = near_copies(random.Random(seed))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
        assert got == brute_join(rows)
        monkeypatch.setattr(ngram_join, "CHUNK", 50)
        monkeypatch.setattr(ngram_join, "BLOCK", 300)


def test_join_rounds_lose_no_link(spark):
    """Sets on the edge of the threshold: links in a chain, which no leader sees as a whole."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 60])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()} == brute_join(rows)


def test_a_shingle_in_every_document(spark, monkeypatch):
    """A passage that all documents have, in blocks that count it once; groups of near copies; sizes at the edge of the threshold."""
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 1 << 12)
    dice = random.Random(21)
    passage, rows = prose(dice, 40), []
    for _ in range(60):
        words = prose(dice, dice.choice((20, 120, 300)), 3000).split()
        for _ in range(dice.choice((1, 1, 2, 7))):
            own = list(words)
            for _ in range(dice.randrange(6)):
                own[dice.randrange(len(own))] = f"x{dice.randrange(10**6)}"
            rows.append(passage + " " + " ".join(own))
    rows += [passage] * 3 + [" ".join([passage] * 2)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_join(rows)
    for local in (2, 16):
        monkeypatch.setattr(ngram_join, "LOCAL", local)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()} == want


def test_ids_with_several_texts_keep_the_first(spark):
    dice = random.Random(22)
    a, b = prose(dice, 80), prose(dice, 80)
    docs = spark.createDataFrame([(1, max(a, b)), (1, min(a, b)), (2, prose(dice, 80))], "doc_id long, text string")
    for parts in (1, 3):
        assert sorted(map(tuple, ngram_join.representatives(docs.repartition(parts)).collect()))[0] == (1, min(a, b))


def test_join_on_odd_tables(odd_docs, no_docs):
    out = ngram_join.join(odd_docs).collect()
    assert len(out) == 17
    by_id = defaultdict(set)
    for r in out:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    want = brute_join(list(dict(rows).items()))
    assert all(by_id[i] == {want[i]} for i in want) and by_id[None] == {(116, None), (0, None)}
    firsts = ngram_join.representatives(odd_docs)
    assert firsts.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in firsts.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.representatives(no_docs).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    out = components.contract(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in out}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[1000 + k] for k in range(50)}) == 1 and roots[0] != roots[1000]


def brute_nearest(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(unit @ unit[q], 12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def test_neighbours(spark):
    dice = np.random.default_rng(3)
    centres = dice.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * dice.standard_normal(16)).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]
    odd = [(6000, None), (6050, [0.0] * 16), (6100, [float("nan")] * 16), (6150, [None] * 16), (6200, [1.0, 2.0]), (6250, []), (None, rows[0][1]), rows[1]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, part int, id int")
    got = defaultdict(list)
    for r in sorted(neighbours.search(table).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    want = brute_nearest(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    copies = [q for q in want if q >= 5000]
    assert copies and all(got[q] == want[q] for q in copies)


def recall(spark, rows):
    want, got = brute_nearest(rows), defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].append(r["vec_id"])
    return sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want))


def probes(spark, rows):
    """Leaves of the index, and how many of them a query goes to."""
    few = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    router = neighbours.learn(few, len(rows))
    return router.leaves, neighbours.measured(neighbours.routed(few, router, 1), router, 5)


def test_random_vectors_take_few_of_the_parts(spark):
    """Vectors without any clusters; recall is measured on queries that nothing was learned from."""
    dice = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(dice.standard_normal((6000, 16)).tolist())]
    leaves, taken = probes(spark, rows)
    assert leaves >= 20 and taken <= leaves / 2
    assert recall(spark, rows) >= 0.9


def test_small_tables_have_parts_too(spark):
    dice = np.random.default_rng(13)
    centres = 2 * dice.standard_normal((10, 16))
    rows = [(i, (centres[i % 10] + dice.standard_normal(16)).tolist()) for i in range(500)]
    leaves, taken = probes(spark, rows)
    assert leaves >= 5 and taken <= (leaves + 1) / 2 and recall(spark, rows) >= 0.9


def test_two_levels_of_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PARTS", 8)
    monkeypatch.setattr(neighbours, "LEAF", 100)
    dice = np.random.default_rng(14)
    rows = [(i, v) for i, v in enumerate(dice.standard_normal((4000, 8)).tolist())]
    leaves, taken = probes(spark, rows)
    assert leaves > 16 and taken <= leaves / 2
    assert recall(spark, rows) >= 0.9


def test_leaves_are_ranked_by_probability(monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PARTS", 4)
    dice = np.random.default_rng(15)
    first, second = dice.standard_normal((6, 3)), {0: dice.standard_normal((6, 4)), 2: dice.standard_normal((6, 2))}
    router, x = neighbours.Router(first, second), dice.standard_normal((50, 5))
    chance = {4: neighbours.softmax(x @ first[:-1] + first[-1])[:, 1]}
    for p, w in second.items():
        inside = neighbours.softmax(x @ w[:-1] + w[-1]) * neighbours.softmax(x @ first[:-1] + first[-1])[:, [p]]
        chance |= {4 * p + k: inside[:, k] for k in range(w.shape[1])}
    names = np.array(sorted(chance))
    order = names[np.argsort(-np.stack([chance[n] for n in names], 1), 1)]
    assert router.leaves == 7
    for most in (1, 2, 3, 7):
        assert (router.ranked(x, most)[:, :most] == order[:, :most]).all()


def test_huge_and_tiny_components(spark):
    dice = np.random.default_rng(16)
    plain = dice.standard_normal((60, 4))
    scale = np.array([1e200, 1e-200, 1.0])[np.arange(60) % 3]
    kinds = "vec_id long, embedding array<double>"
    shown = lambda rows: [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in neighbours.search(spark.createDataFrame(rows, kinds)).orderBy("query_id", "rank").collect()]
    assert shown([(i, (v * k).tolist()) for i, (v, k) in enumerate(zip(plain, scale))]) == shown(list(enumerate(plain.tolist())))


def test_neighbours_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search(few.where("false")).count() == 0 and neighbours.search(few.where("vec_id = 0")).count() == 0


def test_parts_are_balanced():
    dice = np.random.default_rng(4)
    x = dice.standard_normal((600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = neighbours.balanced(x, neighbours.nearest_in(x, 5), 6)
    assert np.bincount(part, minlength=6).max() <= 1.05 * 100 + 1 and part.min() >= 0


def test_warc_records_are_linked(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><li>one</li></nav><!-- c --><p>A &amp; <b>B</b><br>c\n d</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a/b", page, "x"), (1, "http://a/b", page, "x"), (2, None, None, None), (None, "http://c", "", "y")], "page_id long, url string, html string, record string")
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 8 and {r["record_type"] for r in out} == {"metadata", "conversion"}
    source, _ = warc.parse(warc.response(1, "http://a/b", page))
    for r in out:
        headers, block = warc.parse(bytes(r["record"]))
        known = dict(headers)
        assert known["WARC-Refers-To"] == r["refers_to"] and known["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"] and r["content_length"] == len(block)
        if r["page_id"] == 1:
            assert r["refers_to"] == dict(source)["WARC-Record-ID"] and known["WARC-Target-URI"] == "http://a/b" and r["source_digest"] == dict(source)["WARC-Payload-Digest"]
            if r["record_type"] == "conversion":
                assert block.decode() == "one\nA & B\nc\nd"
            else:
                assert b"source-header-content-type: text/html; charset=utf-8" in block
    bad = spark.createDataFrame([(1, b"no"), (2, None), (3, warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b""))], "page_id long, record binary")
    assert [r["record_type"] for r in warc.derive(bad).collect()] == ["invalid"] * 3
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0
