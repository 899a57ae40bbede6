import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import language_id, mixing, packing, quality_classifier, quality_rules, secrets_scan, textstats, token_files, tokens
from tests.llm.conftest import prose

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    twice = [k for k, g in enumerate(grams) if grams.count(g) > 1]
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len({k + d for k in twice for d in range(3)})


def test_counts_match_brute_force():
    dice = random.Random(1)
    cases = [None, "", "a a a a", "x\n x\n\nx\n", "é #é\x1cé * b", "a b c a b c", "\n\n"] + ["".join(dice.choice("ab \n#é") for _ in range(dice.randrange(80))) for _ in range(200)]
    for text in cases:
        assert textstats.counts(text.encode() if text is not None else None)[:5] == brute_counts(text), text


def test_certified_cutoffs_bound_the_risk():
    assert quality_rules.certify([0] * 5, 100, 0.01, 0.05) == []
    assert quality_rules.certify([0, 0, 1, 9], 1000, 0.01, 0.05) == [0, 1, 2]
    p = 0.07
    exact = sum(np.prod([(20 - j) / (j + 1) for j in range(i)]) * p**i * (1 - p) ** (20 - i) for i in range(4))
    assert np.isclose(np.exp(quality_rules.log_binomial_cdf(3, 20, p)), exact)


def test_quality_rules_reject_labelled_junk_and_keep_clean(spark):
    dice = random.Random(2)
    docs, labels = [], []
    for i in range(2600):
        bad = i % 8 == 0
        text = prose(dice, 80, 5000)
        docs.append((i, text.replace(" ", "### ") if bad else text))
        labels.append((i, int(not bad)))
    out = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.05).toPandas().set_index("doc_id")
    bad = out.index % 8 == 0
    assert not out.kept[bad].any() and out.kept[~bad].all() and not out.base_failed.any()


def test_rules_on_odd_tables(odd_docs, odd_labels, no_docs, no_labels):
    out = quality_rules.judge(odd_docs, odd_labels).toPandas()
    assert len(out) == 17
    want = sorted(brute_counts(r["text"]) for r in odd_docs.select("text").collect())
    assert sorted(map(tuple, out[list(quality_rules.BASE)].values.tolist())) == want
    assert all(k != f or not k for k, f in zip(out.kept, out.base_failed))
    kept = quality_rules.keep(odd_docs, odd_labels)
    assert kept.columns == odd_docs.columns and kept.count() == out.kept.sum()
    assert quality_rules.judge(no_docs, no_labels).count() == 0 and quality_rules.keep(no_docs, odd_labels).count() == 0


def brute_secrets(text):
    out = []
    for k, (pattern, group, least) in enumerate((
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, odd_docs, no_docs):
    key = "ghp_" + "a1B2" * 9
    rows = [(1, f"é password = 'abcdefgh12345678' and AKIA{'A1' * 9}", "r1"), (2, f"my {key} here", "r1"), (3, "PASSWD:short token=0123456789abcdef0123", "r2"), (4, "paſſword=abcdefghijklmnop Key", "r2"), (5, None, "r1")]
    shared = "sk_live_" + "Z9y8" * 8
    rows += [(10 + k, f"sample {shared} text", f"r{k}") for k in range(6)] + [rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r.asDict() for r in secrets_scan.find(docs).collect()]
    assert len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        assert r["base_sha256"] == hashlib.sha256(brute_secrets(texts[r["doc_id"]]).encode()).hexdigest()
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert spans[2] == f"vendor:3:{3 + len(key)}" and spans[10] == "" and spans[4] == ""
    assert all(x in spans[1] for x in brute_secrets(texts[1]).split(","))
    redacted = {r["doc_id"]: r["text"] for r in secrets_scan.redact(docs).collect()}
    assert redacted[2] == "my [vendor] here" and redacted[10] == texts[10] and redacted[5] is None and "abcdefgh12345678" not in redacted[1]
    assert secrets_scan.find(odd_docs).count() == 17 and secrets_scan.redact(odd_docs).count() == 17 and secrets_scan.find(no_docs).count() == 0


@pytest.mark.parametrize(("path", "encoder"), [(WORDS, tokens.word_encoder), (BYTES, tokens.byte_encoder)])
def test_cached_ids_are_the_ids_of_the_library(path, encoder):
    from tokenizers import Tokenizer

    plain, dice = Tokenizer.from_file(path), random.Random(3)
    cases = ["a's b'T don't.", "  x  y ", "× ÷ß ŉ İI ſ", "<|endoftext|> a<|startoftext|>b", "é́ é .", "\x1c a\x85b\xa0c", "1a a1 12 ab12.", "\n\n a\n b.\n", "Σς ΑΣ ΟΔΟΣ.", " 's 'll", "the'", "中文 字。", "😀😀 ok", ""]
    cases += ["".join(dice.choice("aZé's .,\n\t1×\xa0ñß!") for _ in range(60)) for _ in range(300)]
    for text, got in zip(cases, encoder(path)(t.encode() for t in cases)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_the_encoder_of_packing_takes_little_memory():
    """Its working arrays, and what it keeps of a text of new words and of long chunks without white space."""
    import tracemalloc

    encode, dice = tokens.word_encoder.__wrapped__(WORDS), random.Random(8)
    known = " ".join(dice.choice("abcde") * dice.randrange(1, 9) for _ in range(4000))
    long = " ".join(f"{n}{'x1' * 60_000}" for n in range(12))
    for _ in encode([b"a b1"]):
        pass
    tracemalloc.start()
    try:
        assert sum(1 for _ in encode([known.encode()] * 500)) == 500
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert sum(1 for _ in encode([long.encode()])) == 1
        assert tracemalloc.get_traced_memory()[0] - before < 4 << 20
    finally:
        tracemalloc.stop()


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    out = packing.pack(odd_docs, WORDS, capacity=64).toPandas()
    want = []
    for r in odd_docs.collect():
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, want)) == sorted(map(key, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.values == own.length.cumsum().values - own.length.values).all() and own.length.sum() <= 64
    assert packing.pack(no_docs, WORDS).count() == 0


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    pack = packing.BestFit(10, 2)
    assert pack.place(6, "a") == [] and pack.place(7, "b") == []
    assert pack.place(3, "c") == [[(0, "b"), (7, "c")]]
    assert pack.place(5, "d") == [] and pack.place(8, "e") == [[(0, "a")]]
    assert sorted(used for used, _ in pack.rest()) == [5, 8]


def test_codes_round_trip_and_random_access():
    dice = np.random.default_rng(4)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], dice.integers(0, 50257, 5000).tolist()):
        sizes, codes = token_files.encode(ids)
        assert token_files.decode(sizes, codes).tolist() == ids and len(codes) == token_files.places(sizes)[-1][0]
        for k in range(0, len(ids), 7):
            assert token_files.token_at(sizes, lambda at, n: codes[at : at + n], k) == ids[k]


def test_single_tokens_of_written_files(spark, tmp_path, monkeypatch):
    """A token takes a few bytes of its file; no segment is decoded."""
    from tokenizers import Tokenizer

    plain, dice = Tokenizer.from_file(BYTES), random.Random(14)
    monkeypatch.setattr(token_files, "SEGMENT", 3000)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1 << 15)
    rows = [(n, prose(dice, 300)) for n in range(60)]
    path = str(tmp_path / "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, BYTES, 0)
    monkeypatch.delattr(token_files, "decode")
    want = [t for _, text in rows for t in [*plain.encode(text, add_special_tokens=False).ids, 0]]
    reader = token_files.Reader(spark, path)
    for k in (0, len(want) - 1, *(dice.randrange(len(want)) for _ in range(40))):
        assert reader.token(k) == want[k]
    before = sum(f.taken for f, _ in reader.files.values())
    assert reader.token(77) == want[77] and sum(f.taken for f, _ in reader.files.values()) - before <= 4 + 4 * (1 + 64 + 4)
    for k in (-1, len(want)):
        with pytest.raises(IndexError):
            reader.token(k)


def test_token_files(odd_docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    plain, at, want = Tokenizer.from_file(BYTES), 0, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in token_files.round_trip(odd_docs, BYTES).orderBy("start").collect()] == want
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1 << 14)
    assert [tuple(r) for r in token_files.round_trip(odd_docs, BYTES).orderBy("start").collect()] == want
    assert token_files.round_trip(no_docs, BYTES).count() == 0


def brute_phrases(sample, text):
    """Longest matches from left to right against the sample's parts."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in p for p in sample):
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_are_longest_matches():
    dice = random.Random(6)
    parts = ["".join(dice.choice("abc") for _ in range(60)) for _ in range(3)]
    table = language_id.automaton([np.frombuffer(p.encode(), np.uint8) - 95 for p in parts], 8)
    for n in (1, 5, 40, 256):
        text = "".join(dice.choice("abcd") for _ in range(n))
        codes = np.zeros((language_id.BLOCK, 1), np.int32)
        codes[:n, 0] = np.frombuffer(text.encode(), np.uint8) - 95
        assert language_id.phrases(table, codes)[0] == brute_phrases(parts, text)


def test_verdicts_are_those_of_brute_force(spark):
    """Texts of one block: the language with the least phrases x log of its sample's length, over its letters."""
    dice = random.Random(15)
    kinds = {"ja": "あいうえおかきくけこ", "xx": "abcdefg", "yy": "abcdefh", "zz": "αβγδ𐐨"}
    make = lambda k: " ".join("".join(dice.choice(kinds[k]) for _ in range(4)) for _ in range(30))
    rows = [(n, make(k), k) for n in range(120) for k in [dice.choice(sorted(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = language_id.sample(docs, language_id.PIECES, language_id.PIECE)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    for n, text, _ in rows:
        cost = {k: brute_phrases(v, text) * np.log2(sum(map(len, v))) for k, v in sampled.items()}
        assert cost[got[n]] <= min(cost.values()) + 1e-9


def test_three_hundred_languages_of_many_letters(spark):
    """Each language has letters of its own, 1800 in all; every one is predicted."""
    dice = random.Random(16)
    own = {f"l{k:03}": [chr(0x4E00 + 6 * k + j) for j in range(6)] for k in range(300)}
    rows = [(10 * i + n, "".join(dice.choice(own[k]) for _ in range(40)), k) for i, k in enumerate(sorted(own)) for n in range(10)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {n: k for n, _, k in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in out)


def test_language_id(spark, odd_docs, no_docs):
    dice = random.Random(7)
    kinds = {"xx": "the and of ing ion", "yy": "der und ung sch ein", "zz": "que los con del ado"}
    make = lambda k: " ".join(dice.choice(kinds[k].split()) + dice.choice(kinds[k].split()) for _ in range(60))
    rows = [(n, make(k), k) for n in range(300) for k in [dice.choice(sorted(kinds))]] + [(900, "123 !!", "xx"), (901, None, "xx"), (902, "", None)]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[n]["lang_pred"] == k for n, _, k in rows[:300]) and all(out[n]["lang_pred"] == "und" and out[n]["score"] == 0 for n in (900, 901, 902))
    assert all(r["held_out"] == (zlib.crc32(str(n).encode()) % 5 == 0) for n, r in out.items())
    assert language_id.identify(odd_docs).count() == 17 and language_id.identify(no_docs).count() == 0


def test_isotonic_is_monotone_and_keeps_totals():
    dice = np.random.default_rng(8)
    count = dice.integers(0, 5, 60).astype(float)
    positive = np.minimum(dice.integers(0, 5, 60), count).astype(float)
    fitted = quality_classifier.isotonic(positive, count)
    assert (np.diff(fitted) >= -1e-12).all() and np.isclose((fitted * count).sum(), positive.sum())


def test_quality_classifier(spark, odd_docs, odd_labels, no_docs, no_labels):
    dice = random.Random(9)
    rows = [(n, prose(dice, 60).replace(" ", "### " if n % 4 == 0 else " ")) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 4 != 0)) for n in range(400)], "doc_id long, quality int")
    out = quality_classifier.score(docs, labels).toPandas()
    held = out[out.held_out]
    assert (held.predicted == (held.doc_id % 4 != 0)).all() and out.score.between(0, 1).all()
    flipped = spark.createDataFrame([(n, int((n % 4 != 0) ^ (zlib.crc32(str(n).encode()) % 5 == 0))) for n in range(400)], "doc_id long, quality int")
    assert np.allclose(quality_classifier.score(docs, flipped).toPandas().sort_values("doc_id").score, out.sort_values("doc_id").score)
    assert quality_classifier.score(odd_docs, odd_labels).count() == 17 and quality_classifier.score(no_docs, odd_labels).count() == 0
    assert set(quality_classifier.score(odd_docs, no_labels).toPandas().score) == {0.5}


def test_scores_are_those_of_brute_force(spark):
    """Features, ridge weights and calibration worked out again by plain means: stacked least squares, and the max-min formula of isotonic regression."""
    dice = random.Random(18)
    rows = [(n, prose(dice, dice.randrange(5, 90), 80).replace(" ", dice.choice([" ", "# ", "\n", "! "]))) for n in range(300)]
    marks = [(n, int(dice.random() < (0.9 if "#" not in text else 0.3))) for n, text in rows]
    out = quality_classifier.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")).toPandas().sort_values("doc_id")
    x = textstats.ratios(list(zip(*(textstats.counts(t.encode()) for _, t in rows))))
    fold, y = np.array([zlib.crc32(str(n).encode()) % 5 for n, _ in rows]), np.array([q for _, q in marks], float)
    own = fold > 0
    mean, spread = x[own].mean(0), np.maximum(x[own].std(0), 1e-6)
    dice = np.random.default_rng(quality_classifier.SEED)
    turn, phase = dice.standard_normal((15, quality_classifier.FEATURES)) / quality_classifier.BANDWIDTH, dice.uniform(0, 2 * np.pi, quality_classifier.FEATURES)
    z = np.concatenate([np.sqrt(2 / quality_classifier.FEATURES) * np.cos(np.clip((x - mean) / spread, -8, 8) @ turn + phase), np.ones((len(x), 1))], 1)

    def ridge(rows):
        held = np.diag([(quality_classifier.RIDGE * rows.sum()) ** 0.5] * quality_classifier.FEATURES + [(1e-9 * rows.sum()) ** 0.5])
        return np.linalg.lstsq(np.concatenate([z[rows], held]), np.concatenate([y[rows], np.zeros(len(held))]), rcond=None)[0]

    bins = lambda values: np.clip((values + 0.5) / 2 * quality_classifier.BINS, 0, quality_classifier.BINS - 1).astype(int)
    spot = np.concatenate([bins(z[fold == k] @ ridge(own & (fold != k))) for k in range(1, 5)])
    told = np.concatenate([y[fold == k] for k in range(1, 5)])
    known = np.unique(spot)
    total, count = np.array([told[spot == b].sum() for b in known]), np.array([(spot == b).sum() for b in known])
    fitted = [max(min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in range(i, len(known))) for a in range(i + 1)) for i in range(len(known))]
    want = np.interp(bins(z @ ridge(own)), known, fitted)
    assert np.mean(np.isclose(out.score, want, atol=1e-9)) > 0.98  # a value on the edge of a bin may fall either way
    assert (out.predicted == (out.score >= 0.3)).all() and (out.held_out.values == (fold == 0)).all()


def test_rates_are_those_of_plain_descent(spark):
    """The same projected descent with the rates of all documents held as one vector; it meets targets that dual ascent shows to be within reach."""
    dice = np.random.default_rng(19)
    p = dice.dirichlet((4, 0.4, 0.5), 200)
    tokens = dice.integers(20, 400, 200)
    table = spark.createDataFrame([(int(t), *map(float, row)) for t, row in zip(tokens, p)], "m_tokens long, m_clean double, m_toxic double, m_low double")
    got = np.array([r["r"] for r in table.withColumn("r", mixing.rate(mixing.fit_rates(table, mixing.TARGETS))).collect()])
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    wanted = share / share[0] * (tokens @ p[:, 0])
    prices = np.zeros(3)
    while np.abs(gap := (np.maximum(0, 1 - p @ prices) * tokens) @ p - wanted).max() > 1e-6 * wanted.sum():
        prices += 0.5 * gap / tokens.sum()
    rates = np.ones(200)
    while np.abs(gap := (rates * tokens) @ p - wanted).max() > 1e-7 * wanted.sum():
        moving = p[rates > 0]
        rates = np.maximum(0, rates - p @ np.linalg.solve(moving.T @ (moving * tokens[rates > 0, None]), gap))
    assert np.allclose(got, rates, atol=1e-6)


def test_certified_chains_and_cutoffs_are_exact():
    from fractions import Fraction
    from math import comb

    def tail(k, n, p):
        return sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))

    dice = random.Random(20)
    for _ in range(40):
        n, risk, delta = dice.randrange(1, 400), dice.choice((0.01, 0.05, 0.2)), dice.choice((0.01, 0.2))
        rejected = sorted(dice.randrange(0, n // 8 + 1) for _ in range(12))
        want = []
        for i, k in enumerate(rejected):
            if k > risk * n or tail(k, n, risk) > Fraction(delta):
                break
            want.append(i)
        assert quality_rules.certify(rejected, n, risk, delta) == want


def test_mixing_meets_targets(spark, odd_docs, odd_labels, no_docs, no_labels):
    dice = random.Random(10)
    rows = [(n, prose(dice, 60) + (" vile vile" if n % 5 == 0 else "") if n % 7 else prose(dice, 60).replace(" ", "### ")) for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 7 != 0), int(n % 5 == 0 and n % 7 != 0)) for n in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.9, "toxic": 0.06, "low": 0.04}
    out = mixing.rates(docs, labels, targets).toPandas()
    got = {k: (out.rate * out.n_tokens * out[f"p_{k}"]).sum() for k in targets}
    total = sum(got.values())
    assert all(abs(got[k] / total - targets[k]) < 1e-4 for k in targets) and (out.rate >= 0).all()
    assert np.allclose(out[[f"p_{k}" for k in targets]].sum(axis=1), 1)
    mixed = mixing.mix(docs, labels, targets)
    assert mixed.columns == docs.columns and abs(mixed.count() - out.rate.sum()) < 4 * len(out) ** 0.5
    assert mixing.rates(odd_docs, odd_labels).count() == 17 and mixing.rates(odd_docs, no_labels).count() == 17
    assert mixing.rates(no_docs, no_labels).count() == 0 and mixing.mix(odd_docs, odd_labels).columns == odd_docs.columns


def test_mixing_keeps_the_balance_of_the_labels(spark):
    """Domains that overlap, and more labels than are sampled: mean posteriors are the shares of the labels, not of the sample."""
    dice, rows, labels = random.Random(12), [], []
    for n in range(2000):
        toxic = n % 10 == 0
        rows.append((n, prose(dice, 60) + (" vile" if dice.random() < (0.6 if toxic else 0.2) else "")))
        labels.append((n, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.posteriors(docs, mixing.fit(docs, labels, most=200, words=1)).toPandas()
    assert abs(got.m_toxic.mean() - 0.1) < 0.03 and abs(got.m_clean.mean() - 0.9) < 0.03


def test_each_private_key_counts_by_its_body(spark):
    """Different keys of one type in many sources are all live; the same one in many is an example; keys are redacted whole."""
    dice = random.Random(13)
    lines = lambda n: ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64)) for _ in range(n)]
    block = lambda body, end="\n": "-----BEGIN RSA PRIVATE KEY-----" + end + end.join(body) + end + "-----END RSA PRIVATE KEY-----"
    same, cut = lines(3), lines(3)
    salted = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0123456789abcdef" * 2, "", *lines(2)]
    bare = "-----BEGIN RSA PRIVATE KEY-----"
    rows = [(k, f"a {block(lines(3))} b", f"r{k}") for k in range(5)]
    rows += [(10 + k, f"a {block(same, (chr(10), chr(13) + chr(10), chr(92) + 'n')[k % 3])} b", f"r{k}") for k in range(5)]
    rows += [(20, f"a {block(salted)} b", "r0"), (21, "a " + bare + "\n" + "\n".join(cut), "r1"), *((30 + k, f"starts with {bare} always", f"r{k}") for k in range(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts, spans = {r[0]: r[1] for r in rows}, {r["doc_id"]: r["spans"] for r in secrets_scan.find(docs).collect()}
    redacted = {r["doc_id"]: r["text"] for r in secrets_scan.redact(docs).collect()}
    for k in range(5):
        assert spans[k] == f"pem:2:{len(texts[k]) - 2}" and redacted[k] == "a [pem] b"
        assert spans[10 + k] == spans[30 + k] == "" and redacted[10 + k] == texts[10 + k]
    assert spans[20].startswith(f"pem:2:{len(texts[20]) - 2},hex:") and redacted[20] == "a [pem] b"
    assert redacted[21] == "a [pem]"


def test_hostile_texts_take_linear_time(spark):
    """Texts of 3 MB, each of which took hours with a pattern that starts over."""
    import time

    from tessera.llm import warc

    began = time.perf_counter()
    for unit in ("eyJ", "<0123456789abcdef0 ghp_aaaaaaaaaaaaaaaaaaaaa ", "-----BEGIN PRIVATE KEY----- A-b:", "abcdefghijklmn://x:y:", "password=abcdefghijklmnop "):
        secrets_scan.matches(unit * (3_000_000 // len(unit)))
    for unit in ("<head", "<a", "<script", "<!--", "<p", "&#9"):
        warc.page_text(unit * (3_000_000 // len(unit)))
    assert time.perf_counter() - began < 60


def test_ownership_counts_distinct_owners(spark):
    dice = random.Random(17)
    keys = ["ghp_" + "".join(dice.choice("abcXYZ019") for _ in range(30)) for _ in range(20)]
    rows = [(n, " ".join(dice.sample(keys, 2)), dice.choice(["a", "b", "", None]), dice.choice(["u", "v", None])) for n in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, owner string")
    got = sorted(tuple(r)[1:] for r in secrets_scan.ownership(secrets_scan.scan(docs, "source", "owner")).select("hash", "n_repositories", "n_owners", "n_rows").collect())
    holders = {k: [r for r in rows + rows[:5] if k in r[1]] for k in keys}
    assert got == sorted((len({r[2] for r in own}), len({r[3] for r in own}), len(own)) for own in holders.values() if own)


def test_long_credentials_in_urls_are_found():
    for user, password in (("u" * 65, "p" * 10), ("user", "p.!" * 60), ("u" * 300, "p,:" * 400)):
        text = f"see https://{user}:{password}@host/x"
        assert secrets_scan.joined(secrets_scan.matches(text)) == f"url:4:{text.index('@') + 1}"


def test_scarce_domains_do_not_shrink_the_mix(spark):
    """1000 clean documents stay whole: a target above what a domain has is reached by copies, or left where no document tells the domain."""
    row = lambda clean, toxic, low: (100, float(clean), float(toxic), float(low))
    kinds = "m_tokens long, m_clean double, m_toxic double, m_low double"

    def got(rows):
        table = spark.createDataFrame(rows, kinds).coalesce(1)
        out = table.withColumn("r", mixing.rate(mixing.fit_rates(table, mixing.TARGETS))).toPandas()
        return out, [(out.r * out.m_tokens * out[f"m_{d}"]).sum() for d in mixing.DOMAINS]

    out, sums = got([row(1, 0, 0)] * 1000 + [row(0, 1, 0)] + [row(0, 0, 1)] * 2)
    assert np.allclose(np.array(sums) / sum(sums), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=1e-5) and np.allclose(out.r[:1000], 1, atol=1e-5)
    out, sums = got([row(0.999 - 1e-5 * (n % 7), 5e-4 + 1e-5 * (n % 7), 5e-4) for n in range(1000)])
    assert out.r.between(0.9, 1.1).all() and abs(sum(sums) / 100_000 - 1) < 0.01
