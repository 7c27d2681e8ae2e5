"""Operators over documents: brute force on small tables, and the defined result of odd rows."""

import collections
import contextlib
import hashlib
import io
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, pii, quality_model, quality_rules, queries, simhash, toxicity, unigram
from evalspark.llm.common import training_rows
from tests.llm.conftest import prose

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 8 <= len(digits) <= 15}.get(kind, lambda: True)():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII_TEXTS = ["", None, "a@b.c_d@e.f g@h", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "x4111 1111 1111 1111y 4111-1111-1111-1112", "+1 (234) 567-8900. +12 3 +1.2",
             "é😀 a.b@c.de 😀+49 30 1234567", "a" * 30_000 + "@b.c", "1 " * 20_000, "9" * 20_000, "+1" + " " * 20_000, "@" * 3_000]


def test_pii_equals_plain_patterns(spark):
    r = random.Random(4)
    texts = PII_TEXTS + ["".join(r.choice("0123456789 .-+@ab()") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_pii(df).collect():
        want = base_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s.split(":")[0] in BASE] == want
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]


def test_pii_checksums_context_and_redaction(spark):
    texts = ["pay to DE89 3704 0044 0532 0130 00 now", "DE88370400440532013000", "my ssn is 123-45-6789", "part 123-45-6789", "card 4111 1111 1111 1111!", "mail a@b.cc or b@c.dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [x["kind"] for x in r.findings] for r in pii.find_pii(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["card"], 5: ["email", "email"]}
    scores = {r.doc_id: r.findings[0]["score"] for r in pii.find_pii(df).collect() if r.findings}
    assert scores[4] == pytest.approx(1.0) and scores[0] == pytest.approx(0.8)
    out = [r.x for r in df.select("doc_id", pii.redacted(df.text).alias("x")).orderBy("doc_id").collect()]
    assert out[0] == "pay to [IBAN] now" and out[4] == "card [CARD]!" and out[5] == "mail [EMAIL] or [EMAIL]"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = np.zeros(64)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        votes += [h >> (63 - i) & 1 for i in range(64)]
    return sum(1 << (63 - i) for i in range(64) if votes[i] * 2 > len(grams))


def components(ids, fps, bits):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_simhash_fingerprints_and_classes(spark):
    texts = [prose(i, 30 + i) for i in range(40)] + [prose(7, 37), "", None, "One", "two Words", "ÀB c D e"] + [prose(9, 300), prose(9, 300) + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == components(list(range(len(texts))), fps, 2)


def test_simhash_tally_counts_shared_lists(spark):
    """Two fingerprints share a list for every choice of five of the bytes they agree in; linked ones reach the minimum."""
    from math import comb
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        fps |= {f ^ sum(r.getrandbits(8) << 8 * p for p in r.sample(range(8), k)) for k in (0, 1, 2, 3, 3, 4)} | {f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(4)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    post = simhash.postings(spark.createDataFrame([(f,) for f in signed], "fp long"))
    other = post.withColumnRenamed("fp", "g")
    got = {(x.fp, x.g): x["count"] for x in post.join(other, ["slot", "bytes"]).where("fp < g").groupBy("fp", "g").count().collect()}
    few = 0
    for a in signed:
        for b in signed:
            if a < b:
                agree = sum((signed[a] ^ signed[b]) >> 8 * p & 255 == 0 for p in range(8))
                assert got.get((a, b), 0) == comb(agree, 5)
                if (signed[a] ^ signed[b]).bit_count() <= 2:
                    assert got[a, b] >= simhash.shared_lists(2) == 6
                few += 0 < got.get((a, b), 0) < 6
    # pairs that meet and that the count filter drops
    assert few > 5


@pytest.mark.parametrize("cap", [2, 32])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_links_join_the_same_classes_for_any_list_cap(spark, cap, bits):
    r = random.Random(cap)
    fps = []
    for _ in range(12):
        f = r.getrandbits(64)
        fps.append(f)
        for _ in range(12):  # chains of near fingerprints: long posting lists
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, cap).collect()
    assert all(((x.u ^ x.v) & (1 << 64) - 1).bit_count() <= bits and x.u != x.v for x in got)
    from evalspark.llm.components import connected_components
    links = spark.createDataFrame([(x.u, x.v) for x in got], "u long, v long")
    root = {x.node: x.root for x in connected_components(links).collect()}
    assert {f: root.get(f, f) for f in signed} == components(signed, [f & (1 << 64) - 1 for f in signed], bits)


def test_components_of_a_long_path_and_a_hub(spark):
    from evalspark.llm.components import connected_components
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1), (3, 2), (2, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 260)) and got[3] == got[2] == 2


def repeat_words(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)})


def test_quality_counts_equal_brute_force(spark):
    r = random.Random(8)
    texts = [prose(i, 5 + 9 * i) for i in range(12)] + ["a b c d e f g h " * 3, "same line\nsame line\n\n\nsame  line", "### $$ x|y <b> & *", "\x0bq w\x0c e", "", None,
                                                           " ".join(r.choice("ab") for _ in range(400))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for row in quality_rules.quality_rules(df).collect():
        t = texts[row.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = repeat_words(w)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert row.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w))


def test_quality_cutoffs_adapt_to_the_group(spark):
    """Source b writes with symbols as a rule and keeps its texts; the same text stands out in source a."""
    loud = lambda i: re.sub(r"(\w+) (\w+)", r"\1 & \2", prose(i, 80))
    rows = [(i, prose(i, 80), "en", "a") for i in range(150)] + [(200 + i, loud(i), "en", "b") for i in range(150)] + [(999, loud(7), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert not got[999].kept and "symbol_ratio" in got[999].reasons and not got[999].base_failed
    assert sum(not got[i].kept for i in got if i != 999) == 0


def brute_measures(text):
    """(ratios by name, what they are taken of) in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    body = "".join(w)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    of = {"n_words": len(w), "word_chars": len(body), "n_lines": len(lines)}
    n = {"symbol_ratio": len(re.findall(r"[#*$%&|<>]", body)), "shout_ratio": body.count("!"), "upper_ratio": sum(c.isupper() for c in body),
         "echo_ratio": sum(a == b for a, b in zip(w, w[1:])), "repeat_ratio": repeat_words(w), "dup_line_ratio": len(lines) - len(set(lines))}
    return {r.name: n[r.name] / max(1, of[r.of]) for r in quality_rules.RATIOS}, of


def brute_verdicts(rows, fence=6.0, prior=10.0):
    """kept by id: exact quantiles of every group, drawn to those of its language and of all."""
    m = {i: (*brute_measures(t), lang, source) for i, t, lang, source in rows}
    at = lambda values, q: float(np.quantile(values, q, method="inverted_cdf"))

    def fences(ids):
        out = {}
        for r in quality_rules.RATIOS:
            values = [m[i][0][r.name] for i in ids]
            alone = r.event / max(1.0, at([m[i][1][r.of] for i in ids], 0.1))
            out[r.name] = at(values, 0.75) + fence * max(at(values, 0.75) - at(values, 0.25), alone)
        return out

    def drawn(n, own, to):
        return {k: n / (n + prior) * own[k] + (1 - n / (n + prior)) * to[k] for k in own}

    enter = [i for i in m if m[i][1]["n_words"] >= 20]
    table = fences(enter)
    out = {}
    for i, (ratios, of, lang, source) in m.items():
        if of["n_words"] < 20 or 100 * round(ratios["repeat_ratio"] * of["n_words"]) > 30 * of["n_words"]:
            out[i] = False
            continue
        same_lang = [j for j in enter if m[j][2] == lang]
        group = [j for j in same_lang if m[j][3] == source]
        cut = drawn(len(group), fences(group), drawn(len(same_lang), fences(same_lang), table))
        out[i] = all(ratios[k] <= cut[k] for k in cut)
    return out


def test_quality_verdicts_equal_brute_force(spark):
    r = random.Random(21)
    rows = []
    for i in range(420):
        text = prose(40_000 + i, r.randrange(10, 120))
        lang, source = r.choice(["en", "de", None]), r.choice(["web", "web", "web", "code", None])
        for mark, share in (("&", 0.5 if source == "code" else 0.02), ("!", 0.02), ("NEWS", 0.03)):
            text = re.sub(r" ", lambda x: f" {mark} " if r.random() < share * r.random() else " ", text)
        if i % 17 == 0:
            text = " ".join(f"{x} {x}" for x in text.split())
        if i % 23 == 0:
            text += "\n" + "\n".join([prose(i, 5)] * r.randrange(2, 9))
        rows.append((i, text, lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(df).collect()}
    want = brute_verdicts(rows)
    assert got == want
    # cutoffs that are the same for all groups cannot say the same
    shares = {i: brute_measures(t)[0]["symbol_ratio"] for i, t, *_ in rows}
    kept_code = max(shares[i] for i, _, _, s in rows if s == "code" and want[i])
    base = {i for i, t, *_ in rows if brute_measures(t)[1]["n_words"] < 20}
    lost_web = [shares[i] for i, _, _, s in rows if s == "web" and not want[i] and i not in base and 0 < shares[i] < kept_code]
    assert lost_web


def brute_path(part, vocab):
    """Best path over characters in plain Python."""
    best = [(0.0, [])] + [None] * len(part)
    index = {p: (i, s) for (i, (p, _, k)), s in zip(enumerate(vocab.pieces), vocab.scores) if k in (unigram.NORMAL, unigram.USER_DEFINED)}
    for a in range(len(part)):
        for b in range(a + 1, min(len(part), a + 24) + 1):
            if part[a:b] in index:
                i, s = index[part[a:b]]
                ids = [i]
            elif b == a + 1:
                s, ids = vocab.unknown_score, [int(vocab.byte_ids[x]) for x in part[a:b].encode()]
            else:
                continue
            if best[b] is None or best[a][0] + s > best[b][0]:
                best[b] = (best[a][0] + s, best[a][1] + ids)
    return best[-1][1]


def test_sentencepiece_paths_and_round_trip(spark):
    vocab = unigram.load()
    texts = ["", None, "a", " ", "  two  spaces ", "hello world\n\nnew", "naïve café 日本語 😀 \u0000x", "tab\tx", "x" * 40, "Ünï €uro"] + [prose(i, 12) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = unigram.encode(df, check=True).collect()
    for r in got:
        assert r.token_ids == brute_path(unigram.prepare(texts[r.doc_id] or "", vocab), vocab), texts[r.doc_id]
        assert r.round_trip and r.n_tokens == len(r.token_ids)
    back = unigram.decode(unigram.encode(df)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_sentencepiece_small_cache_gives_the_same_ids():
    vocab = unigram.load()
    texts = [prose(i, 50) for i in range(30)]
    few, many = unigram.Encoder(vocab, limit=20), unigram.Encoder(vocab)
    a = [few([t])[0].tolist() for t in texts]
    ids, offsets = many(texts)
    assert a == [ids[offsets[i]:offsets[i + 1]].tolist() for i in range(len(texts))]


def test_double_array_finds_exactly_its_keys():
    r = random.Random(2)
    keys = sorted({bytes(r.choice(b"abcdefgh\xc3\xa9") for _ in range(r.randrange(1, 7))) for _ in range(3000)})
    trie = unigram.DoubleArray(keys, range(len(keys)))

    def look(key):
        node = 0
        for c in key:
            nxt = trie.base[node] + c
            if trie.check[nxt] != node:
                return -1
            node = nxt
        return trie.value[node]
    assert [look(k) for k in keys] == list(range(len(keys)))
    assert all(look(k + b"z") == -1 for k in keys)


def test_decontamination_recall_and_clean_texts(spark):
    items = [(i, prose(1000 + i, 18 + i) + "\n" + prose(2000 + i, 4)) for i in range(25)]
    r = random.Random(5)
    rows, want = [], set()
    for i in range(120):
        text = prose(i, 150 + i)
        if i % 3 == 0:  # whole, at any place, in other case and punctuation
            k = i // 3 % 25
            words = text.split()
            at = r.randrange(len(words))
            text = " ".join(words[:at] + [items[k][1].upper().replace(".", " ;")] + words[at:])
            want.add((i, k))
        rows.append((i, text))
    # a paraphrase: a fifth of the words changed, its answer kept
    words = items[3][1].split()
    rows.append((500, prose(77, 60) + " " + " ".join("other" if j % 5 == 2 and j < len(words) - 4 else w for j, w in enumerate(words)) + " " + prose(78, 60)))
    want.add((500, 3))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    # brute force: every item against every stretch of every document
    brute = set()
    for i, text in rows:
        w = decontaminate.words_of(text)
        for k, item in items:
            q = decontaminate.words_of(item)
            number = {x: j for j, x in enumerate(q)}
            n = len(q) + 4
            share = max(decontaminate.lcs([number[x] for x in q], np.array([number.get(x, -1) for x in w[a:a + n]])) for a in range(0, len(w), 4)) / len(q)
            if share >= 0.8:
                brute.add((i, k))
    assert want - {(500, 3)} <= brute and len(got & brute) >= 0.9 * len(brute)
    assert len(got & want) >= 0.9 * len(want)
    assert got <= want
    left = {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in got}


def paraphrases(seed, told, n=24):
    """Items, and documents that hold each with three tenths of its words changed; an answer line stays as it is."""
    r = random.Random(seed)
    flat = lambda k, words: prose(k, words).replace(".\n", " ").strip(".")
    items, rows = [], []
    for k in range(n):
        body, answer = flat(seed * 1000 + k, 22 + k % 9).split(), flat(seed * 2000 + k, 5)
        items.append((k, " ".join(body) + ("\n" + answer if told else "")))
        for j in r.sample(range(len(body)), round(0.3 * len(body))):
            body[j] = "changed"
        rows.append((k, flat(seed * 3000 + k, 70) + " " + " ".join(body) + (" " + answer if told else "") + " " + flat(seed * 4000 + k, 70)))
    return items, rows


@pytest.mark.parametrize("told", [True, False])
def test_paraphrases_are_found(spark, told):
    items, rows = paraphrases(5 + told, told)
    clean = [(1000 + i, prose(600_000 + i, 200)) for i in range(150)]
    docs, bench = spark.createDataFrame(rows + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert len(got & {(k, k) for k, _ in items}) >= 0.9 * len(items)
    assert got <= {(k, k) for k, _ in items}


def test_decontamination_of_shared_columns(spark):
    """With fewer columns than terms what is found stays the same."""
    items, rows = paraphrases(9, True)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, dimensions=64).collect()}
    assert len(got & {(k, k) for k, _ in items}) >= 0.9 * len(items) and got <= {(k, k) for k, _ in items}


def test_decontamination_blocks_give_the_same_pairs(spark, monkeypatch):
    items = [(i, prose(3000 + i, 30)) for i in range(8)]
    docs = spark.createDataFrame([(i, prose(i, 40) + " " + items[i % 8][1]) for i in range(16)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(i, i % 8) for i in range(16)}


def test_basis_is_fitted_on_all_passages(spark):
    """Singular values are those of the TF-IDF rows of every passage, of 90,000 here, and of the benchmark's at equal weight."""
    texts = ["ash bay", "bay cob cob dun", "dun elm other ash", "elm fir", "fir gum ash bay bay"]
    docs = spark.range(90_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int")).alias("text"))
    terms = {w: n for n, w in enumerate(["ash", "bay", "cob", "dun", "elm", "fir", "gum"])}
    block = decontaminate.Block.of([(0, "ash bay cob dun elm fir gum")], terms)
    tokens = decontaminate._tokenise(docs, terms, len(terms)).cache()
    index = decontaminate.fit(tokens, len(terms), lambda: iter([block]))
    held = np.array([[w in t.split() for w in terms] for t in texts], float)
    idf = np.log(90_001 / (1 + 18_000 * held.sum(axis=0))) + 0.1
    assert np.allclose(index.idf, idf)
    corpus, bench = 18_000 * (held * idf).T @ (held * idf), np.outer(idf, idf)
    values = np.linalg.eigvalsh(corpus + np.linalg.norm(corpus) / np.linalg.norm(bench) * bench)[::-1]
    assert np.allclose(index.values ** 2, values, rtol=1e-3, atol=1e-5 * values[0])


@pytest.mark.parametrize("held", [1 << 21, 300])
def test_pairs_of_terms_are_counted_exactly(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "_HELD", held)
    monkeypatch.setattr(decontaminate, "_SORTED", 2000)
    monkeypatch.setattr(decontaminate, "_CELLS", 256)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 100)))) for i in range(60)]
    terms, want = {f"w{n}": n for n in range(40)}, np.zeros((40, 40), int)
    for _, text in rows:
        ids = [terms.get(w, -1) for w in decontaminate.words_of(text)]
        for at in sorted({min(a, max(0, len(ids) - 32)) for a in range(0, len(ids), 32)}):
            on = [t for t in set(ids[at:at + 32]) if t >= 0]
            want[np.ix_(on, on)] += 1
    counts, got = decontaminate._PairCounts(40), np.zeros((40, 40), int)
    flat = [np.array([terms.get(w, -1) for w in decontaminate.words_of(t)], np.int32) for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    found = [b for _, _, t in decontaminate._windows(np.concatenate(flat), offsets, 32) for b in counts.add(decontaminate._columns(t, 40))] + list(counts.rows())
    size = decontaminate._rows_of_block(40) * 40
    for b in found:
        for block, at, n in zip(*(c.to_pylist() for c in b.columns)):
            assert len(at) == len(set(at)) and max(at) < size
            np.add.at(got.reshape(-1), np.array(at) + block * size, n)
    assert (got == np.triu(want)).all()


def test_lcs_equals_dynamic_programming():
    r = random.Random(6)
    for _ in range(50):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 20))], [r.randrange(-1, 6) for _ in range(r.randrange(25))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, np.array(b, int)) == table[-1][-1]


def labelled(spark, label, bad):
    rows = [(i, bad(i) if i % 3 == 0 else prose(i, 60), "en", i % 3 == 0) for i in range(900)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(r[0], int(r[3] == (label == "toxic"))) for r in rows], f"doc_id long, {label} int")
    return docs, y, {r[0]: r[3] for r in rows}


def plain_toxicity(text, model):
    """The score of one text by loops over places, filters and words."""
    words = toxicity._split(text)
    zero = [len(u) for u in model.used]
    at = [[u.get(b, z) for u, b, z in zip(model.used, toxicity._buckets(w), zero)] for w in words] + [zero] * toxicity._PADS
    x = [np.concatenate([t[k] for t, k in zip(model.rows, row)]) for row in at]
    tops, f = [], 0
    for width, filters in zip(toxicity.WIDTHS, model.filters):
        for j in range(filters.shape[1]):
            best = 0.0
            for p in range(len(words) + 1):
                seen = np.concatenate((x[p:] + [np.zeros_like(x[0])] * width)[:width])
                best = max(best, float(seen @ filters[:, j]) + float(model.bias[f]))
            tops.append(best)
            f += 1
    return 1 / (1 + np.exp(-np.clip(float(np.dot(tops, model.out)) + model.offset, -30, 30)))


def test_toxicity_scores_equal_plain_loops_and_pieces():
    texts = [prose(i, 30) + (" you vile dolt" if i % 2 else "") for i in range(60)]
    model = toxicity.train([(t, i % 2) for i, t in enumerate(texts)])
    some = [texts[0], texts[1], "", None, "vile", "dolt vile", prose(900, 100) + " vile dolt " + prose(901, 90), "unknown wörds 12"]
    want = [plain_toxicity(t or "", model) for t in some]
    assert np.allclose(toxicity.score_texts(some, model), want, atol=1e-5)
    for longest in (-1, 20):
        assert np.allclose(toxicity.score_texts(some, model, longest), want, atol=1e-5)
    for piece in (1, 2, 3, 7, 50, 1000):
        assert np.allclose([toxicity._score_long(t or "", model, piece) for t in some], want, atol=1e-5)


def test_training_texts_are_whole(spark):
    texts = {i: prose(i, 8_000 if i % 7 == 0 else 20) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    got = training_rows(docs, y, "toxic", 30).collect()
    assert len(got) > 40 and {r.text for r in got} <= set(texts.values()) and max(len(r.text) for r in got) > 30_000
    few = training_rows(docs, y, "toxic", 30, max_chars=1_500).orderBy("h").collect()
    for c in (0, 1):
        took, whole = [r.text for r in few if r.label == c], [r.text for r in sorted(got, key=lambda r: r.h) if r.label == c]
        short = [t for t in whole if len(t) <= 1_500]
        assert took == short[:len(took)] and sum(map(len, took)) <= 1_500 < sum(map(len, short[:len(took) + 1]))


def test_toxicity_learns_from_every_labelled_row(spark):
    texts = [(prose(i, 12) + (" gromulon" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(40)]
    rows = spark.createDataFrame(texts, "text string, label int").repartition(2, "label")
    used = toxicity._vocabulary(rows, 5)
    for k, u in enumerate(used):
        n = {}
        for t, _ in texts:
            for b in {toxicity._buckets(w)[k] for w in toxicity._split(t)}:
                n[b] = n.get(b, 0) + 1
        assert u == {b: i for i, b in enumerate(sorted(b for b, c in n.items() if c >= 5))}
    flat, weight = toxicity._untrained(used), {0: 1.0, 1: 1.0}
    mem = np.full_like(flat, 1e-3)
    got, squares = toxicity._round(rows, flat, mem, used, "k", weight)
    moved, counted, added = np.zeros_like(flat), np.zeros(len(flat)), np.zeros_like(flat)
    for part in rows.rdd.glom().collect():
        own, own_mem = flat.copy(), mem.copy()
        toxicity._learn([(r.text, r.label) for r in part], own, own_mem, used, "k", weight)
        moved += own - flat
        added += own_mem - mem
        counted += (own != flat).any(axis=1) | (own_mem != mem).any(axis=1)
    assert np.allclose(got, flat + moved / np.maximum(counted, 1)[:, None], atol=1e-4) and np.allclose(squares, mem + added, atol=1e-3)
    docs = spark.createDataFrame([(i, "en", t) for i, (t, _) in enumerate(texts)], "doc_id bigint, lang string, text string")
    known = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "_id bigint, label int")
    model, seen = toxicity.fit(docs, known), {b for t, _ in texts for w in toxicity._split(t) for b in toxicity._buckets(w)[:1]}
    assert set(model.used[0]) <= seen and toxicity._buckets("gromulon")[0] in model.used[0]


def test_toxicity_labels_come_to_the_texts(spark, tmp_path, monkeypatch):
    n = 9_000
    docs = spark.range(n).selectExpr("if(id % 97 = 5, null, id div 2) as doc_id", "if(id % 50 = 7, null, concat('text ', id)) as text", "if(id % 2 = 0, 'en', null) as lang")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(70).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.range(n // 2).selectExpr("if(id % 40 = 3, null, id) as doc_id", "case id % 5 when 0 then 1 when 1 then null else 0 end as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    plans, kept = [], toxicity.scratch

    def watched(df, name, *parts):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        plans.append((name, out.getvalue()))
        return kept(df, name, *parts)
    monkeypatch.setattr(toxicity, "scratch", watched)
    monkeypatch.setattr(toxicity, "ENOUGH", 1)
    monkeypatch.setattr(toxicity, "FEW", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many labels
    try:
        assert queries.op5_toxicity(spark, str(tmp_path)).count() == n + 70
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = dict(plans)["toxicity-texts"]
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: .*ENSURE_REQUIREMENTS", plan)
    assert moved and not any("text#" in x for x in moved), plan
    known = toxicity._labelled(labels).withColumnRenamed("_id", "doc_id")
    got, want = (sorted(map(tuple, toxicity._with_labels(docs, known, x).collect()), key=repr) for x in (toxicity.FILE_ROWS, None))
    assert got == want and len(got) > 4_000 and {r[2] for r in got} == {0, 1} and len(set(got)) < len(got)


def test_toxicity_tasks_learn_mixtures_of_sorted_tables(spark, tmp_path, monkeypatch):
    spark.range(0, 4_000, 1, 4).selectExpr("id * 1789 % 4001 as doc_id", "concat('text ', id) as text").write.parquet(f"{tmp_path}/sorted")
    known = spark.range(4_000).selectExpr("id * 1789 % 4001 as _id", "int(id < 1000) as label")
    kept, rows = toxicity.scratch, []
    monkeypatch.setattr(toxicity, "scratch", lambda *x: rows.append(kept(*x)) or rows[0])
    monkeypatch.setattr(toxicity, "ENOUGH", 1)
    monkeypatch.setattr(toxicity, "FEW", 0)
    toxicity.fit(spark.read.parquet(f"{tmp_path}/sorted"), known, toxicity.FILE_ROWS)
    assert rows[0].count() == 4_000
    for k in range(toxicity.SLICES):
        got = [r.label for r in rows[0].where(f"slice = {k}").collect()]
        assert all(25 < sum(got[i:i + 200]) < 85 for i in range(0, len(got) - 200, 200))


def test_toxicity_long_texts_train_in_pieces():
    model = toxicity.train([(prose(i, 40) + (" gromulon" if i % 2 else ""), i % 2) for i in range(20)])
    text = prose(3, 200) + " gromulon " + prose(4, 90)
    whole = toxicity._best(text, model)
    for piece in (3, 17, 64):
        part = toxicity._best(text, model, 1, piece)
        assert np.allclose(whole[0], part[0], atol=1e-5) and np.allclose(toxicity._embed(whole[1][0], model), toxicity._embed(part[1][0], model))


def test_toxicity_thresholds_are_exact_in_steps(spark):
    rows = [("en", 0.1, 0), ("en", 0.2, 1), ("en", 0.3, 0), ("en", 0.8, 1), ("en", 0.9, 1), ("de", 0.4, 0), (None, 0.05, 0), (None, 0.999, 1)]
    got = {r.lang: r.threshold for r in toxicity.calibrate(spark.createDataFrame(rows, "lang string, score double, label int")).collect()}
    # en: 3 of 4 at 0.2 give 6/7, 2 of 2 at 0.8 give 4/5; the step below 0.2 is that of 0.1
    assert set(got) == {"en", None} and abs(got["en"] - 0.15) < 0.002 and 0.05 < got[None] <= 0.95


def test_toxicity_held_out(spark):
    insults = "gromulon blastardo vexiform".split()
    docs, y, bad = labelled(spark, "toxic", lambda i: prose(i, 30) + f" {insults[i % 9 // 3]}{'' if i % 2 else 'en'} " + prose(i + 1, 30))
    got = [r for r in toxicity.score_toxicity(docs, y).collect() if r.held_out]
    assert np.mean([(r.predicted == 1) == bad[r.doc_id] for r in got]) > 0.95 and len(got) > 100
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_score_does_not_depend_on_neighbours():
    texts = [prose(i, i) for i in range(12)] + ["", None]
    model = toxicity.train([(prose(i, 40) + (" gromulon" if i % 2 else ""), i % 2) for i in range(60)])
    alone = np.array([toxicity.score_texts([t], model)[0] for t in texts])
    assert np.allclose(alone, toxicity.score_texts(texts, model), atol=1e-6)


def test_quality_model_held_out(spark):
    docs, y, bad = labelled(spark, "quality", lambda i: prose(i, 60).replace(" ", "### ") if i % 2 else " ".join([prose(i, 1)] * 60))
    got = [r for r in quality_model.score_quality(docs, y).collect() if r.held_out]
    assert np.mean([(r.predicted == 0) == bad[r.doc_id] for r in got]) > 0.95 and len(got) > 100


def test_quality_model_score_does_not_depend_on_neighbours():
    texts = [prose(i, 3 * i) for i in range(40)] + ["", None, "z" * 700]
    model = quality_model._new()
    alone = np.array([quality_model.score_texts([t], model)[0] for t in texts])
    assert np.allclose(alone, quality_model.score_texts(texts, model), atol=1e-5)


def test_quality_model_gradient_is_right():
    model, texts = quality_model._new(), [prose(i, 40 + 9 * i) for i in range(4)]
    y, w = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        p = quality_model.score_texts(texts, model)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    g = quality_model._step(texts, y, w, model)
    for name, at in (("w3", (2,)), ("w2", (3, 1)), ("w1", (5, 2)), ("b1", (4,))):
        value = getattr(model, name)
        old, eps = value[at], 2e-3
        value[at] = old + eps
        up = loss()
        value[at] = old - eps
        down = loss()
        value[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_rows_of_one_id_with_other_texts_stay_unless_copies(spark):
    a, b, c, d = (prose(5_000 + i, 80) for i in range(4))
    rows = [(3, b), (5, a), (5, b), (7, c), (7, d), (7, d), (9, c), (9, a), (None, a)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(3, b), (5, a), (7, c), (7, d), (0, a)])


def test_odd_rows(spark, odd_docs, labels):
    n = odd_docs.count()
    bench = spark.createDataFrame([(1, prose(2, 60)), (None, prose(3, 40)), (3, None), (4, "")], "item_id long, text string")
    assert pii.find_pii(odd_docs).count() == n
    assert {r.text for r in pii.redact(odd_docs).where("doc_id = 2").collect()} == {None}
    near = simhash.near_duplicates(odd_docs).collect()
    assert len(near) == n and {r.fingerprint for r in near if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert all(r.component_id == 2 for r in near if r.fingerprint == "0" * 16)
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 2
    judged = quality_rules.quality_rules(odd_docs)
    assert judged.count() == n and judged.where("doc_id = 2 and base_failed and not kept").count() == 1
    assert quality_rules.keep_good(odd_docs).columns == odd_docs.columns
    tokens = unigram.encode(odd_docs, check=True)
    assert tokens.count() == n and tokens.where("not round_trip").count() == 0
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs, bench).collect()}
    assert leaks == {(1, 1), (None, None)}
    left = decontaminate.drop_leaks(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == n - 3
    for scored in (toxicity.score_toxicity(odd_docs, labels), quality_model.score_quality(odd_docs, labels)):
        got = scored.collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (2, 3)}) == 1


def test_empty_tables(spark, no_docs, labels):
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (pii.find_pii(no_docs), pii.redact(no_docs), simhash.near_duplicates(no_docs), simhash.drop_near_duplicates(no_docs), quality_rules.quality_rules(no_docs),
                quality_rules.keep_good(no_docs), unigram.encode(no_docs), decontaminate.find_leaks(no_docs, bench), decontaminate.drop_leaks(no_docs, bench),
                decontaminate.find_leaks(no_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")),
                toxicity.score_toxicity(no_docs, labels), quality_model.score_quality(no_docs, labels.limit(0))):
        assert out.count() == 0


def _peak(run) -> int:
    """Bytes that ``run`` holds beyond what there was before, at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_decontaminate_transposed_product_is_bounded():
    """Passages by their thousands, as of a table with one very common passage, need no product of all their terms at once."""
    rng = np.random.default_rng(3)
    terms = decontaminate._columns(rng.integers(0, 1500, (4096, decontaminate.PASSAGE)).astype(np.int32), 1500)
    idf, y = rng.random(1500) + 0.1, rng.random((4096, 96)).astype(np.float32)
    dense = np.zeros((4096, 1500), np.float32)
    p, j = np.nonzero(terms >= 0)
    dense[p, terms[p, j]] = idf[terms[p, j]]
    assert np.allclose(decontaminate._transposed(terms, idf, y, 1500), dense.T.astype(np.float64) @ y, rtol=1e-4)
    # all terms at once would be 50 MB, 65,536 of them 25 MB, and twice that while they are weighted
    assert _peak(lambda: decontaminate._transposed(terms, idf, y, 1500)) < 20e6


def test_sentencepiece_learns_long_texts_in_bounded_memory():
    vocab = unigram.load()
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(40_000)]
    text = " ".join([*words, "x" * 70_000])
    ids, offsets = unigram.Encoder(vocab)([text, "", words[0]])
    alone = [unigram.viterbi(vocab.parts.findall(unigram.prepare(t, vocab)), vocab)[0] for t in (text, words[0])]
    assert offsets.tolist() == [0, len(alone[0]), len(alone[0]), len(alone[0]) + len(alone[1])]
    assert ids.tolist() == [*alone[0].tolist(), *alone[1].tolist()]
    few = _peak(lambda: unigram.Encoder(vocab)([" ".join(words[:10_000])]))
    # four times the words, but not four times the matches at once
    assert _peak(lambda: unigram.Encoder(vocab)([" ".join(words)])) < 2.2 * few
