"""The text-corpus operators against libraries, brute force and defined edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, chat_format, decontamination, language_id, near_duplicates, quality_classifier, quality_rules, secret_scan, sharding, token_counts
from granary.session import read_table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, _r string, _match string"
WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "1234 !!", "en"), (5, "é" * 3, "fr"), (5, "é" * 3, "fr"), (None, "a b c", "en"),
    (7, prose(1, 60_000), "en"), (8, "x" * 200_000, "en"), (9, prose(2, 100), "en"), (9, prose(2, 100), "en"), (10, "a\0b ퟿ \U0001f600", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, 0.5, "r", "m") for i, t, g in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Language identification


def test_language_accuracy_on_held_out(spark):
    docs = read_table(spark, MEDIUM, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(spark, docs.where(~out))
    found = language_id.identify(spark, docs.where(out).select("doc_id", "text", "lang"), model).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_mixture_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(300, 0.2), 3).T + 1e-9
    n = rng.multinomial(4000, 0.6 * p[:, 0] / p[:, 0].sum() + 0.4 * p[:, 2] / p[:, 2].sum())
    seen = n > 0
    chosen, pi = language_id.mixture(p[seen], np.log(p[seen]), n[seen])
    assert sorted(chosen) == [0, 2]
    assert abs(dict(zip(chosen, pi))[0] - 0.6) < 0.05
    only = rng.multinomial(4000, p[:, 1] / p[:, 1].sum())
    assert language_id.mixture(p[only > 0], np.log(p[only > 0]), only[only > 0])[0] == [1]


def test_language_mixture_of_more_than_three():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(300, 0.2), 7).T + 1e-9
    p /= p.sum(0)
    for shares in ([0.36, 0.24, 0.2, 0.2], [0.3, 0.2, 0.2, 0.15, 0.15], [1 / 7] * 7):
        n = rng.multinomial(6000, p[:, : len(shares)] @ shares)
        seen = n > 0
        chosen, pi = language_id.mixture(p[seen], np.log(p[seen]), n[seen])
        assert sorted(chosen) == list(range(len(shares)))
        assert max(abs(dict(zip(chosen, pi))[i] - x) for i, x in enumerate(shares)) < 0.05


def plain_mixture(counts: dict[int, int], p: np.ndarray) -> tuple[dict[int, float], float]:
    """The best set of languages over all sets, by plain EM and the penalised likelihood."""
    import itertools

    total = sum(counts.values())
    best, out = -np.inf, {}
    for size in range(1, p.shape[1] + 1):
        for chosen in itertools.combinations(range(p.shape[1]), size):
            pi = [1 / size] * size
            for _ in range(400):
                part = [0.0] * size
                for x, n in counts.items():
                    whole = sum(w * p[x, c] for w, c in zip(pi, chosen))
                    for k, c in enumerate(chosen):
                        part[k] += n * pi[k] * p[x, c] / whole
                pi = [v / total for v in part]
            fit = sum(n * np.log(sum(w * p[x, c] for w, c in zip(pi, chosen))) for x, n in counts.items())
            fit -= (size - 1) * (0.5 * np.log(total + 1) + 1)
            if fit > best:
                best, out = fit, dict(zip(chosen, pi))
    return out, best


def test_mixture_equals_plain_search_over_all_sets():
    rng = np.random.default_rng(29)
    for _ in range(12):
        p = rng.dirichlet(np.full(25, 0.3), 3).T + 1e-6
        p /= p.sum(0)
        n = rng.multinomial(int(rng.integers(30, 400)), p @ rng.dirichlet(np.full(3, 0.5)))
        seen = np.flatnonzero(n)
        chosen, pi = language_id.mixture(p[seen], np.log(p[seen]), n[seen])
        want, _ = plain_mixture({x: int(n[x]) for x in seen}, p)
        assert sorted(chosen) == sorted(want) and max(abs(want[c] - w) for c, w in zip(chosen, pi)) < 0.02


def test_language_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abc abc", "b", 7), (2, "abc abc", "a", 8)], "doc_id long, text string, lang string, score int")
    got = language_id.identify(spark, docs, language_id.train(spark, docs))
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_1", "languages", "proportions"]
    assert [(r["lang_pred"], r["score"]) for r in got.orderBy("doc_id").collect()] == [("a", 7), ("a", 8)]


def test_language_edges(spark, odd, none):
    model = language_id.train(spark, odd)
    rows = language_id.identify(spark, odd, model).select("doc_id", "text", F.col("lang_pred")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    empty = language_id.train(spark, none)
    assert {r["lang_pred"] for r in language_id.identify(spark, odd, empty).select("lang_pred").collect()} == {"und"}
    assert language_id.identify(spark, none.select("doc_id", "text"), model).count() == 0


# Quality classification


def test_quality_held_out(spark):
    docs, labels = read_table(spark, MEDIUM, "documents"), read_table(spark, MEDIUM, "labels")
    out = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(spark, docs.where(~out), labels)
    got = quality_classifier.classify(spark, docs.where(out), model).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_difference_and_score_by_definition():
    import zstandard

    good, bad = prose(15, 4000).encode(), b" ".join(b"%x" % (i * 7919) for i in range(8000))
    model = quality_classifier.Model(good, bad, 0.5)
    model.weights = [0.0, 1.0, 0.3, 0.01, 0.2, 1.7]
    rnd = random.Random(28)
    for _ in range(40):
        text = " ".join(rnd.choice([prose(rnd.randint(0, 99), 30), "%x" % rnd.getrandbits(900), "é ß 中"]) for _ in range(rnd.randint(0, 30)))
        sizes = []
        for d in (good, bad):
            size = 0
            for at in range(0, len(text.encode()), 2048):
                one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                size += len(one.compress(text.encode()[at : at + 2048]))
            sizes.append(size)
        want = (sizes[1] - sizes[0]) / sum(sizes) if text else 0.0
        assert model.difference(text) == want
        assert abs(model.score(text) - 1 / (1 + np.exp(-(0.3 + 1.7 * (want - 0.01) / 0.2)))) < 1e-12


def test_labels_of_copies_and_of_few_texts_still_teach(spark):
    good, bad = prose(16, 900), " ".join("%x" % (i * 7919) for i in range(900))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(400)], "doc_id long, text string")
    model = quality_classifier.train(spark, docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    assert model.score(good[:600]) > 0.5 > model.score(bad[:600])


def test_quality_edges(spark, odd, none):
    marks = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (9, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    for docs, labels in ((odd, marks), (odd, marks.where("quality = 1")), (none, marks), (odd, marks.limit(0))):
        model = quality_classifier.train(spark, docs, labels)
        rows = quality_classifier.classify(spark, odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.classify(spark, none, model).count() == 0


def test_logistic_regression_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0).astype(float)
    w = quality_classifier.fit_logistic(x, y)
    assert ((quality_classifier.logistic(w, x) > 0.5) == (y > 0)).mean() > 0.9


# N-gram Jaccard join


def brute_links(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id to (class, links to other shingle sets)."""

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([("empty", t or "")])

    sets = {i: shingles(t) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    up, links = {i: i for i in reps}, collections.Counter()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(reps):
        for b in reps[:n]:
            if not (texts[a] or "").split() or not (texts[b] or "").split():
                continue
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (find(first[sets[i]]), links[first[sets[i]]]) for i in sets}


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 16)
    rnd = random.Random(5)
    texts: dict[int, str | None] = {}
    for g in range(12):
        base = prose(100 + g, rnd.choice([8, 40, 150])).split()
        base = [f"{w}{rnd.randint(0, 40)}" for w in base]
        for _ in range(rnd.choice([1, 3, 45])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 9999)}"
            texts[len(texts)] = " ".join(w)
    for t in (None, "", "  ", "one two", "one  two", "one two three", "z" * 90_000):
        texts[len(texts)] = t
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.find(spark, docs).collect()}
    want = brute_links(texts)
    empties = [i for i, t in texts.items() if not (t or "").strip()]
    assert {i: v for i, v in got.items() if i not in empties} == {i: v for i, v in want.items() if i not in empties}
    assert all(got[i][1] == 0 for i in empties)
    kept = near_duplicates.keep_one(spark, docs.withColumn("_md5", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v[0] for v in got.values()})
    assert kept.columns == ["doc_id", "text", "_md5"]


def test_join_of_the_table_equals_an_inverted_index(spark):
    """All pairs at 0.8 or more among the texts of a table, by shared shingles; recall and classes must be whole."""
    docs = read_table(spark, MEDIUM, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := (t or "").split())}
    places = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    links = collections.Counter()
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in places[x] if j != i)
        links[i] = sum(n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9 for j, n in common.items())
    got = {r["doc_id"]: r["n_linked_docs"] for r in near_duplicates.find(spark, docs).collect()}
    assert sum(links.values()) > 100
    assert {i: n for i, n in got.items() if i in sets} == {i: links[i] for i in sets}


def test_join_edges(spark, odd, none):
    rows = near_duplicates.find(spark, odd).collect()
    assert len(rows) == len(ODD) and all(r["n_links"] == 0 for r in rows)
    assert near_duplicates.find(spark, none).count() == 0
    assert near_duplicates.keep_one(spark, odd).count() == 9  # null and empty are copies, 5 and 9 are repeated rows
    assert near_duplicates.keep_one(spark, none).columns == none.columns


def test_classes_with_null_or_shared_ids_stay_apart(spark):
    texts = [prose(200 + i, 60) for i in range(6)]
    near = texts[0] + " end"
    docs = spark.createDataFrame([(None, texts[0]), (None, near), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (7, texts[5])], "doc_id long, text string")
    rows = near_duplicates.find(spark, docs).collect()
    assert len(rows) == 8 and len({r["class_key"] for r in rows}) == 6
    assert {r["n_links"] for r in rows if r["doc_id"] is not None} == {0}
    kept = [(r["doc_id"], r["text"]) for r in near_duplicates.keep_one(spark, docs).collect()]
    assert len(kept) == 6 and sorted(i for i, _ in kept if i is not None) == [5, 5, 5, 7]
    assert {t for _, t in kept} - {texts[0], near} == set(texts[1:])


def test_word_hashes_tell_words_apart(monkeypatch):
    rnd = random.Random(21)
    text = "".join(rnd.choice(["a", "b", "ab", "é", "中", " ", "\n", "\u3000", "\x1c", "\xa0", "zz" * 40, "q" * 5000 if rnd.random() < 0.01 else "q"]) for _ in range(60_000))
    words = text.split()
    monkeypatch.setattr(near_duplicates, "LONG_WORD", 60)  # no longer than the smallest block, as in use
    number: dict[str, int] = {}
    want = [number.setdefault(w, len(number)) for w in words]
    for block in (1 << 17, 1000, 64):
        monkeypatch.setattr(near_duplicates, "BLOCK_CHARS", block)
        near_duplicates._powers.cache_clear()
        got = near_duplicates.word_hashes(text).tolist()
        seen: dict[int, int] = {}
        assert [seen.setdefault(h, len(seen)) for h in got] == want
        if block == 1 << 17:
            first = got
        assert got == first
    near_duplicates._powers.cache_clear()
    assert [len(near_duplicates.word_hashes(t)) for t in ("", " \n", "x", " x ", "x" * 300_000, "x" * 300_000 + " y")] == [0, 0, 1, 1, 1, 2]


def test_pruning_bounds_are_lossless_at_threshold():
    least = near_duplicates.least_matches(0.8)
    assert all(a <= b for a, b in zip(least, least[1:]))
    rng = np.random.default_rng(2)
    draws = rng.random((20_000, near_duplicates.HASHES)) < 0.8
    counts = draws.cumsum(1)[:, near_duplicates.STEP - 1 :: near_duplicates.STEP]
    assert (counts < np.array(least)).any(1).mean() < 1e-3


def test_intersections_dense_equals_sparse():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(30)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert near_duplicates.intersections(sets, sets, i, j).tolist() == want


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def odd_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'r", "'x", "a", "b", "e", "re", "the", "ing", " of", "S", " ", "  ", "\n", "\t", " \n", "1", "23", "½", "é", "ß", "中", "!", "..", "<|endoftext|>", "<|endo", "\xa0", "　", "_", "€", "\U0001f600", "\0", "\x1c", "\x85", "́", "zzz"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_tiktoken_in_both_forms(spark, vocabulary):
    import tiktoken

    ranks = bpe.load_ranks(vocabulary.path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(120, 1) + [None, "", "x" * 700, "ab" * 400, "é" * 200, prose(3, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for form in (bpe.encode, bpe.encode_with_expressions):
        rows = {r["doc_id"]: r for r in form(spark, docs, vocabulary, with_ids=True).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            ids = library.encode_ordinary(text or "")
            assert list(rows[i]["token_ids"]) == ids and rows[i]["n_tokens"] == len(ids)
            assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_edges(spark, vocabulary, odd, none):
    assert bpe.encode(spark, odd, vocabulary).count() == len(ODD)
    assert bpe.encode(spark, none, vocabulary, with_ids=True).collect() == []


# Secret scan


def plain_base(text: str | None) -> str:
    text, out = text or "", []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rnd = random.Random(4)
    parts = ["password", "API_KEY", "apikey", "Token", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEF123456", "0123456789abcdef", "deadbeef", "x", "é", "hunter2hunter2", ".", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        assert secret_scan._joined(secret_scan.scan(t)[0]) == plain_base(t)
    docs = read_table(spark, MEDIUM, "documents").select("doc_id", "text")
    want = {r["doc_id"]: hashlib.sha256(plain_base(r["text"]).encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in secret_scan.scan_secrets(spark, docs).collect()} == want


def test_random_runs_found_and_prose_left():
    rnd = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = 0
    for _ in range(200):
        key = "".join(rnd.choice(alphabet) for _ in range(40))
        hits += secret_scan.random_spans(f"see {key} there", []) == [(4, 44)]
    assert hits > 190
    for quiet in ("internationalization of_some_long_identifier_name aVeryLongCamelCaseIdentifier", "/usr/local/lib/python3/site-packages/module", "2024-01-01-2025-12-31-0000000000000", "-" * 60, prose(5, 4000)):
        assert secret_scan.random_spans(quiet, []) == []


def test_keys_beside_other_signs_and_base_spans_found():
    rnd = random.Random(12)
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    after_path = after_name = after_base = 0
    for _ in range(200):
        url = "".join(rnd.choice(plain + "-_") for _ in range(38)) + "-_"
        text = f"see host/path/{url} there"
        after_path += any(4 <= s <= 14 and e == 54 for s, e in secret_scan.random_spans(text, []))
        key = "".join(rnd.choice(plain + "+/") for _ in range(38)) + "+/"
        found = secret_scan.random_spans(f"see of_some_name_{key} there", [])
        after_name += any(4 <= s <= 17 and e == 57 for s, e in found)
        before = "".join(rnd.choice(plain) for _ in range(40))
        text = f"{before}_token=abcdefghijklmnop {prose(13, 9)}"
        after_base += any(s == 0 and 40 <= e <= 41 for s, e in secret_scan.random_spans(text, [(s, e) for s, _, e in secret_scan.base_spans(text)]))
    assert min(after_path, after_name, after_base) > 185
    for quiet in ("/usr/local/lib/python3/site-packages/some_module/of-the-other_kind", "https/example/blog/2024-01-01/a-long_title-of-many_words/index"):
        assert secret_scan.random_spans(quiet, []) == []


def test_plain_words_leave_recall_as_it_is():
    rnd = random.Random(14)
    lower = "abcdefghijklmnopqrstuvwxyz"
    plain = lower.upper() + lower + "0123456789"
    words = " ".join("".join(rnd.choice(lower) for _ in range(22)) for _ in range(300))
    for chars, n, least in ((plain + "+/", 32, 0.85), (plain, 24, 0.7), (plain, 20, 0.5)):
        keys = ["".join(rnd.choice(chars) for _ in range(n)) for _ in range(100)]
        found = [secret_scan.random_spans(f"{words} {k}", []) for k in keys]
        assert [bool(x) for x in found] == [bool(secret_scan.random_spans(k, [])) for k in keys]
        assert sum(map(bool, found)) >= least * len(keys)


def test_keys_planted_in_the_table(spark):
    rnd = random.Random(24)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = collections.Counter()
    texts = [r["text"] or "" for r in read_table(spark, MEDIUM, "documents").select("text").collect()]
    for text in texts:
        assert "random" not in secret_scan._joined(secret_scan.scan(text)[1])
        for n in (24, 32, 40):
            at = rnd.choice([m.end() for m in re.finditer(r"\s", text)] or [0])
            key = "".join(rnd.choice(chars) for _ in range(n))
            spans = secret_scan.scan(f"{text[:at]} {key} {text[at:]}")[1]
            found[n] += (at + 1, 3, at + 1 + n) in spans
    assert found[24] > 0.8 * len(texts) and found[32] > 0.93 * len(texts) and found[40] > 0.97 * len(texts)


def test_written_runs_are_rarely_discoveries(spark):
    """Identifiers joined from the words of a table, and from a few very short words, which change class most often."""
    rnd = random.Random(25)
    own = sorted({w for r in read_table(spark, SMALL, "documents").collect() for w in re.findall("[a-z]{3,}", r["text"] or "")})
    joins = [lambda p: "".join(map(str.title, p)), lambda p: "_".join(p) + str(rnd.randint(0, 99)), lambda p: "-".join(p).title(), lambda p: "/".join(p) + f"/{rnd.randint(2000, 2030)}"]
    for words, most in ((own, 0.01), (WORDS, 0.06)):
        made = [rnd.choice(joins)([rnd.choice(words) for _ in range(9)]) for _ in range(3000)]
        assert sum(bool(secret_scan.random_spans(f"see {x} there", [])) for x in made) < most * len(made)


def test_discoveries_follow_the_rule_by_definition():
    rnd = random.Random(26)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(60):
        parts = ["".join(rnd.choice(chars[: rnd.choice([30, 40, 62])]) for _ in range(rnd.randint(20, 34))) for _ in range(rnd.randint(1, 30))]
        ps = []
        for x in parts:
            name, index = secret_scan.infer_encoding(x) or (None, None)
            if name:
                tests = secret_scan.battery([index[c] for c in x], len(index), secret_scan.groups_of(name))
                ps.append((x, secret_scan.written_p(tests, len(x), name) if secret_scan.fisher(tests) >= secret_scan.RANDOM_P else 1.0))
        limit = max((p for _, p in ps if p <= secret_scan.FDR * sum(q <= p for _, q in ps) / len(ps)), default=-1.0)
        text = " ".join(parts)
        assert {text[a:b] for a, b in secret_scan.random_spans(text, [])} == {x for x, p in ps if p <= limit}


def test_overlaps_cost_linear_time():
    import time

    text = " ".join(f'token="{i:016x}abcdefgh" AbCdEfGhIjKlMnOpQrSt{i:04d}' for i in range(4000))
    seconds = []
    for t in (text, text + " " + text):
        start = time.perf_counter()
        secret_scan.scan(t)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 3.2 * seconds[0]


def test_battery_p_values_are_about_uniform():
    rng = np.random.default_rng(7)
    ps = np.array([secret_scan.battery(rng.integers(0, 16, 200).tolist(), 16) for _ in range(400)])
    assert (abs((ps < 0.1).mean(0) - 0.1) < 0.06).all()
    assert max(secret_scan.battery([0, 15] * 50, 16)) < 1e-3


def test_secret_edges(spark, odd, none):
    rows = secret_scan.scan_secrets(spark, odd).collect()
    assert len(rows) == len(ODD) and all(r["n_assign"] == r["n_hex"] == 0 for r in rows)
    red = secret_scan.redact_secrets(spark, spark.createDataFrame([(1, 'x token = "abcdefghijklmnop" y'), (2, None)], "doc_id long, text string")).collect()
    assert [r["text"] for r in red] == ['x [assign]" y', None]
    assert secret_scan.scan_secrets(spark, none).count() == 0


# Decontamination


def brute_tiling(a: list, b: list, least: int) -> int:
    """Greedy string tiling by its definition; tokens covered."""
    mark_a, mark_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not mark_a[i + k] and not mark_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return covered
        k, i, j = best
        for x in range(k):
            mark_a[i + x] = mark_b[j + x] = True
        covered += k


def test_tiling_equals_definition():
    rnd = random.Random(8)
    for _ in range(60):
        item = [rnd.choice("abcdef") for _ in range(rnd.randint(3, 25))]
        doc = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))]
        for _ in range(3):
            s, at = rnd.randrange(len(item)), rnd.randrange(len(doc) + 1)
            doc[at:at] = item[s : s + 8]
        index = decontamination.Index([(1, " ".join(item))], seed=3)
        if not index.items:
            continue
        found = index.matches(" ".join(doc), 0.0)
        assert (found[0]["matched_tokens"] if found else 0) == brute_tiling(item, doc, 3)


def test_tiles_and_ties_equal_definition():
    rnd = random.Random(27)
    for _ in range(150):
        a = [rnd.randint(1, 3) for _ in range(rnd.randint(0, 30))]
        b = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 40))]
        assert sum(t[2] for t in decontamination.tile(np.array(a, np.int32), np.array(b, np.int32), 3)) == brute_tiling(a, b, 3)


def test_repeated_lines_cost_no_product():
    import time

    line = prose(70, 8)
    index = decontamination.Index([(1, " . ".join([line] * 200)), (2, prose(71, 40))])
    start = time.perf_counter()
    (found,) = index.matches("\n".join([line] * 20_000))
    assert found["item_id"] == 1 and found["coverage"] == 1.0 and time.perf_counter() - start < 20


def test_short_items_and_scripts_without_blanks():
    index = decontamination.Index([(1, "Two words"), (2, "今天的天气非常好我们去公园散步吧"), (3, ""), (4, "!!")])
    ids = lambda t: [m["item_id"] for m in index.matches(t)]
    assert ids("two  WORDS!") == [1] and ids("two words more") == [] and ids("") == [] and ids("!!") == []
    assert ids("他说今天的天气非常好，我们去公园散步吧。") == [2] and ids("完全不同的一句话没有关系") == []


def test_leaks_found_in_any_order(spark, none):
    items = [(i, prose(50 + i, 30) + f" unique{i} passage{i} of item{i} number{i}") for i in range(5)] + [(9, "short one"), (10, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    w = items[2][1].split()
    moved = " ".join(w[20:]) + " . " + prose(60, 50) + " , " + " ".join(w[:20])
    docs = spark.createDataFrame([(1, prose(61, 300)), (2, prose(62, 40) + " " + items[0][1].upper() + "! " + prose(63, 9)), (3, moved), (4, None), (5, ""), (3, moved)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark, docs, benchmark).collect())
    assert found == [(2, 0), (3, 2), (3, 2)]
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(spark, docs, benchmark).collect()) == [1, 4, 5]
    assert decontamination.find_leaks(spark, docs, benchmark.limit(0)).count() == 0
    assert decontamination.find_leaks(spark, none, benchmark).count() == 0
    assert decontamination.drop_contaminated(spark, none, benchmark).columns == none.columns


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    docs, benchmark = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "benchmark")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(decontamination.find_leaks(spark, docs, benchmark))
    monkeypatch.setattr(decontamination, "BLOCK_TOKENS", 1500)
    assert key(decontamination.find_leaks(spark, docs, benchmark)) == whole


# Sharding


def test_shards_are_exact_and_gapless(spark):
    docs = read_table(spark, MEDIUM, "documents").repartition(5)
    got = sharding.digest(spark, docs, 8).toPandas()
    assert len(got) == 1000 and set(got.law) == {"rows"}
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and len(sizes) == 8
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    assert got.grown_shard.isna().all()


def test_shards_with_many_blocks_keep_columns(spark):
    docs = spark.range(0, 1003, 1, 7).select(F.col("id").alias("doc_id"), F.lit("a").alias("slot"), F.lit(2).alias("_src"))
    got = sharding.shuffle_to_shards(spark, docs, 3, block_rows=50).toPandas()
    assert list(got.columns) == ["doc_id", "slot", "_src", "shard", "slot_1"]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot_1) == list(range(len(part)))
    assert sorted(got.doc_id) == list(range(1003))


def test_communication_matrix_has_its_margins_and_law():
    m = sharding.communication_matrix([10, 0, 7, 23], [14, 13, 13], 3)
    assert m.sum(1).tolist() == [10, 0, 7, 23] and m.sum(0).tolist() == [14, 13, 13] and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix([10, 30], [20, 20], s)[0, 0] for s in range(400)])
    assert abs(mean - 5) < 0.3


def test_draws_have_the_exact_law_on_both_sides_of_the_library_limit():
    from math import comb

    rng = np.random.default_rng(4)
    for good, bad, n in ((9, 7, 8), (3, 40, 11), (60, 90, 70)):
        for draw in (sharding.hypergeometric, sharding._draw_large):
            got = draw(rng, np.full(40_000, good), np.full(40_000, bad), np.full(40_000, n))
            low, high = max(0, n - bad), min(n, good)
            want = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(low, high + 1)])
            seen = np.bincount(got - low, minlength=len(want)) / len(got)
            assert abs(seen - want).max() < 0.012
    big = sharding.hypergeometric(rng, np.full(20_000, 4 * 10**10), np.full(20_000, 6 * 10**10), np.full(20_000, 10**10))
    sd = (10**10 * 0.4 * 0.6 * 0.9) ** 0.5
    assert abs(big.mean() - 4 * 10**9) < 4 * sd / 20_000**0.5 and abs(big.std() / sd - 1) < 0.02
    assert abs((abs(big - 4 * 10**9) < sd).mean() - 0.6827) < 0.015


def test_communication_matrix_of_a_hundred_billion_rows():
    sources = [25 * 10**9 + i for i in range(4)] + [0, 1]
    total = sum(sources)
    targets = [total // 8 + (i < total % 8) for i in range(8)]
    m = sharding.communication_matrix(sources, targets, 5)
    assert m.sum(1).tolist() == sources and m.sum(0).tolist() == targets and (m >= 0).all()
    want = np.outer(np.array(sources[:4], float), np.array(targets, float)) / total
    assert (abs(m[:4] - want) < 6 * want**0.5).all()


def test_matrix_law_equals_all_permutations():
    import itertools

    seen, want = collections.Counter(), collections.Counter()
    for order in itertools.permutations(range(6)):  # rows 0 to 5 of sources 0, 0, 1, 1, 1, 2; places of targets 0, 0, 1, 1, 2, 2
        m = np.zeros((3, 3), int)
        for place, row in enumerate(order):
            m[[0, 0, 1, 1, 1, 2][row], place // 2] += 1
        want[m.tobytes()] += 1 / 720
    for s in range(6000):
        seen[sharding.communication_matrix([2, 3, 1], [2, 2, 2], s).astype(int).tobytes()] += 1 / 6000
    assert seen.keys() == want.keys()
    assert sum((seen[k] - want[k]) ** 2 / want[k] for k in want) * 6000 < len(want) + 4 * (2 * len(want)) ** 0.5


def test_whole_shuffle_is_uniform_over_all_permutations(spark):
    """Many tables of four rows, each with two sources and two shards, in one run; all 24 orders must be equally likely."""
    from granary.session import Scratch

    n = 6000
    rows = spark.range(4 * n).select(F.col("id").alias("at"), (F.floor(F.col("id") / 4) * 4).cast("long").alias("block"), F.when(F.col("id") % 4 < 3, 0).otherwise(1).cast("long").alias("source"))
    scratch = Scratch(spark, "test")
    names = {k: k for k in ("at", "block", "source", "rank")}
    plan = {4 * b: ([(0, 3), (1, 1)], [(4 * b, 2), (4 * b + 2, 2)]) for b in range(n)}
    sent = sharding.exchange(spark, scratch, rows, plan, names, 3)
    again = sharding.Window.partitionBy("block").orderBy(F.xxhash64(F.lit(2), "at"), "at")
    got = sent.select("at", (F.col("block") + F.row_number().over(again) - 1).alias("place")).toPandas().sort_values("place")
    assert got.place.tolist() == list(range(4 * n))
    orders = collections.Counter(tuple(x) for x in (got["at"].values.reshape(-1, 4) % 4).tolist())
    assert len(orders) == 24 and sum((c - n / 24) ** 2 / (n / 24) for c in orders.values()) < 23 + 4 * 46**0.5
    scratch.close()


def test_rounds_of_blocks_lose_nothing(spark):
    docs = spark.range(0, 5003, 1, 9).select(F.col("id").alias("doc_id"))
    for cells in (1 << 22, 24):
        got = sharding.shuffle_to_shards(spark, docs, 3, block_rows=40, matrix_cells=cells).toPandas()
        assert sorted(got.doc_id) == list(range(5003)) and got.groupby("shard").size().tolist() == [1668, 1668, 1667]
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
        assert abs(np.corrcoef(got.doc_id, got["shard"] * 1668 + got.slot)[0, 1]) < 0.06


def test_shard_edges(spark, odd, none):
    got = sharding.digest(spark, odd, 8).collect()
    assert len(got) == len(ODD)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.digest(spark, none, 8).count() == 0


# Quality rules


def plain_rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n, r = len(words), len(cover)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_rules_equal_plain_python(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a", "b ", " ", "\n", "\x0b", "\x1c", "é ", "# ", "|", "a b c d e f g h ", "\xa0", "\r\n"]) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for t in texts:
        assert tuple(quality_rules.base_features(t)[2][n] for n in names) == plain_rules(t)
    docs = read_table(spark, SMALL, "documents")
    want = {r["doc_id"]: plain_rules(r["text"]) for r in docs.collect()}
    got = quality_rules.apply_rules(spark, docs, quality_rules.references(spark, docs)).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == want


def test_divergence_separates_labels(spark):
    docs, labels = read_table(spark, MEDIUM, "documents"), read_table(spark, MEDIUM, "labels")
    got = quality_rules.apply_rules(spark, docs, quality_rules.references(spark, docs)).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.15


def test_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality_rules.js_distance(p, q) == pytest.approx(1) and quality_rules.js_distance(p, p) == 0


def test_references_and_verdicts_by_brute_force(spark, monkeypatch):
    """Histograms, distances, limits and verdicts in plain Python, over a whole table and with tasks that hold few words."""
    import math
    import statistics

    monkeypatch.setattr(quality_rules, "HELD_WORDS", 300)
    rows = read_table(spark, SMALL, "documents").select("doc_id", "text", "lang").collect()
    docs = spark.createDataFrame(rows).repartition(3)
    refs = quality_rules.references(spark, docs)
    words, classes = collections.defaultdict(collections.Counter), {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            words[r["lang"]].update(re.findall(rb"[^\x20\x09-\x0D]+", r["text"].encode()))
            classes[r["lang"]] = classes.get(r["lang"], 0) + quality_rules.class_counts(r["text"].encode())
    assert refs.languages == sorted(words)

    def distance(p, q):
        total = 0.0
        for x, y in zip(p, q):
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
        return math.sqrt(max(0.0, total))

    common = {g: {w: n / c.total() for w, n in c.items() if n >= quality_rules.COMMON_SHARE * c.total()} for g, c in words.items()}
    for g in refs.languages:
        assert {w: refs.shares[g][i] for w, i in refs.words[g].items()} == pytest.approx(common[g])
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark, docs, refs).collect()}
    want = {}
    for r in rows:
        data = (r["text"] or "").encode()
        own = re.findall(rb"[^\x20\x09-\x0D]+", data)
        if len(own) < quality_rules.MIN_WORDS:
            assert got[r["doc_id"]]["kept"] != got[r["doc_id"]]["base_failed"]
            continue
        c = quality_rules.class_counts(data)
        found = []
        for g in sorted(words):
            q = [own.count(w) / len(own) for w in common[g]]
            pair = distance(c / c.sum(), classes[g] / classes[g].sum()), distance([*q, 1 - sum(q)], [*common[g].values(), 1 - sum(common[g].values())])
            found.append(pair)
        want[r["doc_id"]] = (min(found, key=sum), len(own))
    limit = []
    for k in (0, 1):
        less = [d[k] - quality_rules.SLACK / math.sqrt(n) for d, n in want.values()]
        m = statistics.median_low(less)
        limit.append(m + 3.5 / 0.6745 * max(0.01, statistics.median_low([abs(x - m) for x in less])))
    failed = 0
    for i, (d, n) in want.items():
        assert (got[i]["class_distance"], got[i]["word_distance"]) == pytest.approx(d, abs=1e-6)
        over = max(d[0] - limit[0], d[1] - limit[1]) - quality_rules.SLACK / math.sqrt(n)
        failed += over > 0
        if abs(over) > 1e-6:
            assert got[i]["kept"] == (over <= 0 and not got[i]["base_failed"])
    assert failed > 5


def test_rule_edges(spark, odd, none):
    refs = quality_rules.references(spark, odd)
    rows = quality_rules.apply_rules(spark, odd, refs).collect()
    assert len(rows) == len(ODD)
    assert [r["kept"] for r in rows if r["doc_id"] in (1, 2, 3)] == [False] * 3
    empty = quality_rules.references(spark, none)
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.apply_rules(spark, odd, empty).collect())
    assert quality_rules.apply_rules(spark, none, refs).count() == 0


# Token counts


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(4000, 2) + ["", "a" * 3000, " " * 2000, "ab" * 700, "x" * 513, prose(4, 5000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    own = token_counts.Counter(path)
    assert own.texts(texts) == want
    assert [own.texts([t])[0] for t in texts[:300]] == want[:300]
    docs = read_table(spark, SMALL, "documents")
    got = token_counts.count_tokens(spark, docs, path).collect()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        assert r["n_tokens"] == len(library.encode(rows[r["doc_id"]], add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 512) and r["n_bytes"] == len(rows[r["doc_id"]].encode())


def test_transducer_emits_what_merges_give():
    own = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")).transducer
    rnd = random.Random(22)
    for _ in range(3000):
        kind = rnd.choice([(b"ing", b"the", b"in", b"g"), b"abcdefghijklmnopqrstuvwxyz", b"aeinrst", bytes(range(256)), b"01", b" -_=*#", "éàüßñçè".encode()])
        piece = b"".join(x if isinstance(x, bytes) else bytes([x]) for x in rnd.choices(kind, k=rnd.randint(1, 60)))
        state, emitted = own.run_one(piece, own.START)
        assert emitted + own.flush[state] == len(own.merge([own._first[b] for b in piece]))


def test_slices_and_forgotten_states_give_the_same(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(23)
    texts = ["".join(odd_texts(40, seed)) for seed in range(40)] + ["x" * 3000, " " * 500 + "a", "it's we're " * 90, "'re" * 200, "\u3000 \n " * 90, prose(8, 900)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for size in (64, 65, 66, 67, 500):
        monkeypatch.setattr(token_counts, "SLICE_CHARS", size)
        monkeypatch.setattr(token_counts, "MOST_STATES", rnd.choice([3000, 250_000]))
        assert token_counts.Counter(path).texts(texts) == want


def test_scan_equals_sequential_run(monkeypatch):
    rng = np.random.default_rng(10)
    classes = rng.integers(0, 12, 5000).astype(np.uint8)
    state, want = 0, []
    for c in classes:
        want.append(state)
        state = token_counts.NEXT[state, c]
    for chunk, head in ((512, 24), (7, 2), (64, 1)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "HEAD", head)
        assert token_counts.run_states(classes).tolist() == want


def test_token_count_edges(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(spark, odd, path).collect()
    assert len(rows) == len(ODD) and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert token_counts.count_tokens(spark, none, path).count() == 0


# Chat formatting


def test_chat_round_trip(spark):
    rnd = random.Random(11)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<sep>", "\\", "[", "<", "/", "\n", " ", "%0A", "x", "é", "INST]", "SYS>>"]
    roles = ["user", "assistant", "system", "tool", None, "a\n<sep>%"]
    rows = [(c, t, rnd.choice(roles), rnd.choice([None, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))])) for c in range(150) for t in range(rnd.randint(1, 6))]
    rows += [(900, 0, "user", "a"), (900, 0, "user", "a"), (900, 0, "user", "b"), (900, None, "assistant", "n"), (None, 1, "user", "u"), (901, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append(((t is not None, t or 0), role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        turns = sorted(groups[r["conv_id"]])
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_mask"]]
        undo = lambda x: re.sub(r"([\[<])\\(\\*)(/?INST\]|/?s>|</?SYS>>|sep>)", r"\1\2\3", x)
        assert [undo(x) for x in masked] == [t for _, role, t in turns if role == "assistant"]
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_loss_is_read_under_the_mask(spark):
    rows = [(1, 0, "user", "é[INST]"), (1, 1, "assistant", "\ufeff</s>\U0001f600 yes"), (1, 2, "assistant", "\ufeffmore"), (1, 3, "user", "x"), (1, 4, "assistant", "")]
    rows += [(2, t, ("user", "assistant")[t % 2], f"turn {t} é") for t in range(3000)]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256("\ufeff</s>\U0001f600 yes\ufeffmore".encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in rows[5:] if r == "assistant").encode()).hexdigest()
    for change in (lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length")), lambda x: F.struct(x["start"].alias("start"), (x["length"] - 1).alias("length"))):
        moved = formatted.withColumn("loss_mask", F.transform("loss_mask", change))
        for r in chat_format.digest(moved).collect():
            assert r["loss_sha256"] != got[r["conv_id"]]["loss_sha256"] and r["turns_sha256"] == got[r["conv_id"]]["turns_sha256"]


def test_chat_equals_sql(spark):
    import duckdb

    from granary.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{MEDIUM}/conversations.parquet')")
    got = queries.op10_chat_format(spark, MEDIUM)
    want = con.execute(queries.OP10_SQL)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read_table(spark, SMALL, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == names, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((rows := stage(spark, docs, SMALL)).collect(), rows.schema)
    assert docs.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
