"""Operators over the whole corpus against plain Python: search, mixing, URL rules, groups, models, pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfold.llm import logbilinear, mixing, neardup, queries, topk, toxicity, urlrules

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- exact top-k -------------------------------------------------------------------------------

def brute_topk(rows, k=5, scale=256):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok = list({(i, tuple(v)) for i, v in ok})
    out = set()
    for q, v in ok:
        if q is not None and q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for c, w in ok if c != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(found)}
    return out


@pytest.mark.parametrize("rules", [topk.TopkRules(), topk.TopkRules(query_rows=2, block_rows=7, warm_rows=8)])
def test_topk(spark, rules):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, rng.choice([0.1, 1, 3])) for _ in range(12)]) for i in range(400)]
    rows += [(i, [0.5] * 12) for i in range(400, 450)] + [(450, None), (451, []), (452, [None] + [1.0] * 11), (500, [float("nan")] * 12), (453, [float("inf")] * 12)]
    rows += [(None, [9.0] * 12), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (650, [0.0] * 12), (50, rows[50][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    is_query = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    got = [tuple(r) for r in topk.search(table, is_query, rules).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_topk(rows)
    assert topk.search(table.limit(0), is_query, rules).count() == 0


# ---- mixing ------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, odd, documents, empty, clashing):
    skewed = spark.createDataFrame([(i, "w " * (i % 40 + 1), None, "big" if i % 3 else f"s{i % 30}é", 1) for i in range(3000)], documents.schema)
    for table in (odd, documents, skewed):
        for rules in (mixing.MixRules(), mixing.MixRules(range_rows=37)):
            rows = mixing.mix_plan(table, rules).collect()
            size = defaultdict(int)
            for r in table.collect():
                size[r.source] += len(words(r.text))
            want = brute_targets(size)
            taken, largest = defaultdict(int), defaultdict(int)
            for r in rows:
                assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.copies <= 3
                taken[r.source] += r.copies * r.size
                largest[r.source] = max(largest[r.source], r.size)
            assert len(rows) == table.count() and all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in size)
            assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(table.repartition(7), rules).collect()))
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(documents).collect()}
    assert Counter(r.doc_id for r in mixing.mixed(documents).collect()) == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed(clashing).columns == clashing.columns


# ---- URL rules ---------------------------------------------------------------------------------

def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in urlrules.UrlRules().listed for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules_and_mining(spark):
    rng = random.Random(5)
    urls = [rng.choice(["http", "https"]) + "://" + rng.choice(["", "www.", "ÀB."]) + rng.choice(["Example.com", "x.net", "casino.net", "y.org", "com", "notexample.com"])
            + rng.choice(["/en/", "/es/a", "/fr/12", "/de/7?u=://", "", "#/en/", "/casino/win"]) for _ in range(600)]
    urls += [None, "", "no scheme/en/", "://", "a\nb://www.Example.com/en/\nx"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = urlrules.UrlRules(support=0.02, confidence=0.8)
    got = {r.page_id: r for r in urlrules.judge(pages, rules).collect()}
    labelled = []
    for i, u in enumerate(urls):
        host, path, rule = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0]), u
        tokens = frozenset({f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in re.split("[^a-z0-9]+", re.sub("[0-9]+", "0", path.lower())) if x})
        if rule:
            assert got[i].verdict == rule[1]
            labelled.append((tokens, rule[1] == "block"))
        got[i] = (got[i].verdict, tokens, rule)
    sets = {frozenset(c) for t, b in labelled if b for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    strong = []
    for s in sets:
        have = [b for t, b in labelled if s <= t]
        if sum(have) >= rules.support * len(labelled) and sum(have) / len(have) >= rules.confidence:
            strong.append(s)
    assert strong
    for verdict, tokens, rule in got.values():
        if not rule:
            assert verdict == ("block" if any(s <= tokens for s in strong) else "allow")
    assert urlrules.judge(pages.limit(0)).count() == 0


# ---- near duplicates ---------------------------------------------------------------------------

def brute_groups(rows, n):
    sets = {}
    for i, text in rows:
        w = [re.sub("[A-Z]", lambda x: x[0].lower(), x) for x in words(text)]
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    for a, i in enumerate(by_size):
        for j in by_size[a + 1:]:
            if len(sets[j]) * 80 > 100 * len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(n_words):
    """Texts with exact copies, near copies in chains and one large family, all of known groups."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for f in range(30):
        base = [word() for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(150 if f == 0 else rng.randrange(1, 6)):
            mine = list(base)
            for _ in range(rng.randrange(0, 1 + len(mine) // 30)):
                mine[rng.randrange(len(mine))] = word()
            rows.append(" ".join(mine).upper() if rng.random() < 0.2 else " ".join(mine))
            if rng.random() < 0.3:
                base = mine
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n_words,rules", [(2, {}), (5, {"region": 8})])
def test_groups(spark, n_words, rules):
    rows = families(n_words) + [(10_001, None), (10_002, ""), (10_003, "Word"), (10_004, "wORD"), (10_005, " \t"), (10_006, "a b c"), (10_007, "a b c d")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.grouped(table, neardup.NearRules(words=n_words, **rules)).collect()}
    assert got == brute_groups(rows, n_words)


def template_texts(n: int, pairs: int, rng: random.Random):
    """Texts of one template, 0.797 alike, and ``pairs`` more, each of which shares one more word with one of them: 0.817."""
    rows = [[f"t{i}" for i in range(160)] for _ in range(n + pairs)]
    for k, text in enumerate(rows):
        for i in range(8, 152, 16):                                             # a changed word is two shingles of two words
            text[i] = f"u{rng.getrandbits(48)}"
        if k >= n:
            text[8] = rows[k - n][8]
    return list(enumerate(map(" ".join, rows)))


def test_links_in_over_full_regions(spark):
    """Isolated pairs of a template lie in regions too full at every depth, which were dealt at random."""
    rows = template_texts(700, 80, random.Random(3))
    want = {i: i - 700 if i >= 700 else i for i, _ in rows}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.grouped(table, neardup.NearRules(words=2, region=8)).collect()}
    assert got == want


def test_common_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (1, 5, 40, 80, 200)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for width in (1, 7, 8192):
        got = neardup.common_counts(sets, width)
        assert all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)
    assert neardup.common_counts([np.array([1], np.uint64), np.array([2], np.uint64)])[0, 1] == 0


def test_later_links_join_groups_without_grouping_all_again(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(neardup, "connected_components", lambda edges, f=neardup.connected_components: sizes.append(edges.count()) or f(edges))
    sets = lambda *x: [y.encode() * 16 for y in x]
    groups = spark.createDataFrame([(x, sets("a")[0]) for x in sets(*"abcd")] + [(x, sets("e")[0]) for x in sets(*"ef")], "node binary, component binary")
    links = spark.createDataFrame([tuple(sets("d", "f")), tuple(sets("x", "y")), tuple(sets("f", "z"))], "a binary, b binary")
    found = {bytes(r.node)[:1].decode(): bytes(r.component)[:1].decode() for r in neardup._merged(groups, links).collect()}
    assert found == dict.fromkeys("abcdefz", "a") | dict.fromkeys("xy", "x") and sizes == [3]
    assert neardup._merged(groups, links.limit(0)) is groups and sizes == [3]


def test_one_row_of_each_group_stays(odd, empty, clashing):
    kept = neardup.deduplicated(odd).collect()
    assert len(kept) == odd.count() - 1 and sum(r.doc_id == 6 for r in kept) == 1 and any(r.doc_id is None for r in kept)
    assert neardup.grouped(empty).count() == 0
    assert neardup.deduplicated(clashing).columns == clashing.columns and neardup.deduplicated(clashing).count() == len(kept)


# ---- toxicity ----------------------------------------------------------------------------------

def test_gradients():
    rules = toxicity.ToxicRules(hidden=3, word_dims=2, char_dims=2, char_buckets=8)
    net, rng = toxicity.Network(rules, 4), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(5, 4, 4)), np.arange(5)[:, None] < np.array([5, 3, 1, 4]), np.array([1.0, 0, 1, 0])
    x0 = x.astype(np.float32)

    def loss():
        both = [net.read(s, x0 @ net.p[f"x{s}"] + net.p[f"o{s}"], mask) for s in "fb"]
        z = net.pool(np.concatenate(both, axis=2), mask)[2]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))
    grad, _ = net.gradients(x0, mask, y, np.ones(4))
    for name in ("a", "w", "b", "xf", "hf", "of", "xb", "hb", "ob"):
        for at in list(np.ndindex(net.p[name].shape))[:6]:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-2
            up = loss()
            net.p[name][at] = old - 1e-2
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3, (name, at)


def test_windows_cover_whole_texts():
    rules = toxicity.ToxicRules()
    for n in (1, 31, 32, 33, 48, 49, 1000):
        seen = {x for s in toxicity.windows_of(n, rules) for x in range(s, min(n, s + rules.window))}
        assert seen == set(range(n))


def test_trigrams_of_many_words():
    some = [b"a", b"the", "wörd".encode(), b"^$", bytes(range(1, 9)), b"\xff" * 40] + [str(i).encode() for i in range(300)]
    grams, lens = toxicity.all_trigrams(some, 4096)
    assert grams.tolist() == [g for w in some for g in toxicity.trigrams(w, 4096)] and lens.tolist() == [len(toxicity.trigrams(w, 4096)) for w in some]


def test_a_passage_lies_whole_in_a_window_at_every_offset():
    rules = toxicity.ToxicRules()
    for long in (17, rules.window - rules.stride + 1):                          # with neighbours 24 apart only 9 words were sure
        for at in range(400 - long + 1):
            assert any(s <= at and at + long <= s + rules.window for s in toxicity.windows_of(400, rules)), (long, at)
    rng = random.Random(5)
    clean, foul = [f"plain{i}".encode() for i in range(60)], [f"vile{i}".encode() for i in range(17)]
    prose = lambda n: [rng.choice(clean) for _ in range(n)]
    texts = [b" ".join(prose(40) + (foul if i % 2 else []) + prose(60)) for i in range(200)]
    net, words = toxicity.fit_network(texts, np.arange(200) % 2, rules)
    table, body = toxicity._Table(toxicity.Model(net, words, 0.0)), prose(200)
    scores = toxicity.score_texts([b" ".join(body)] + [b" ".join(body[:i] + foul + body[i:]) for i in range(201)], table, rules)
    assert scores[0] < 0 < scores[1:].min()


def test_toxicity_held_out(spark, odd, empty, clashing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = toxicity.ToxicRules(sample=600, epochs=4)
    model = toxicity.fit(docs, labels, rules)
    rows = toxicity.score(docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), model, keep=["doc_id", "toxic"], rules=rules).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    test = [(r.toxicity, r.toxic) for r in rows]
    pairs = [(a > b) + (a == b) / 2 for a, x in test for b, y in test if x > y]
    assert sum(pairs) / len(pairs) > 0.85
    end = spark.createDataFrame([(1, "plain words go on and on here " * 400), (2, "plain words go on and on here " * 400 + "you worthless idiot, you stupid disgusting moron")], "doc_id long, text string")
    near = {r.doc_id: r.toxicity for r in toxicity.score(end, model, rules=rules).collect()}
    assert near[1] < 0.5 < near[2]
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(odd, model, rules=rules).collect()) and toxicity.score(empty, model, rules=rules).count() == 0
    assert toxicity.score(clashing, model, rules=rules).columns == [*clashing.columns, "_toxicity"]
    blank = toxicity.fit(docs, labels.where("toxic = 0"), rules)
    assert {r.toxicity < 0.01 for r in toxicity.score(odd, blank, rules=rules).collect()} == {True}


# ---- language model ----------------------------------------------------------------------------

def test_language_model(spark, odd, documents, empty):
    table = odd.unionByName(documents)
    rows = logbilinear.score(table, logbilinear.LblRules(classes=50, frequent=300)).collect()
    texts = [(r.doc_id, [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in words(r.text)] + [None]) for r in table.collect()]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in texts if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for i, t in texts)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 for r in rows) and logbilinear.score(empty).count() == 0


def test_model_is_normalised_and_learns():
    rng, k = np.random.default_rng(2), 12
    rules = logbilinear.LblRules(dims=8, noise=16)
    ids = np.zeros(60_000, np.int64)
    for i in range(1, len(ids)):                                                # a word is mostly followed by the next one
        ids[i] = (ids[i - 1] + 1) % (k - 2) if rng.random() < 0.8 else rng.integers(k - 2)
    codes = logbilinear._trigrams(ids, k - 1, k)
    share = np.bincount(codes % k, minlength=k) + 0.1
    model = logbilinear.Lbl(np.log(share / share.sum()), rules)
    every, counts = np.unique(codes, return_counts=True)
    for _ in range(10):
        model.train(every, counts, rules)
    sums, far, near = model.log_sums(), codes // k // k, codes // k % k
    s = model.predicted(far, near) @ model.p["target"].T + model.p["bias"] - sums[far, near][:, None]
    assert np.allclose(np.exp(s).sum(1), 1, atol=1e-4)
    assert s[np.arange(len(codes)), codes % k].mean() > np.log(share / share.sum())[codes % k].mean() + 0.5


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, judged = docs.columns, {r.doc_id: r.kept for r in queries.op2_tokeniser_fertility(spark, SF).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = stage[0](spark, docs, SF).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, k in judged.items() if k}
    two = stage[1](spark, one, SF).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in one.collect()], 5)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(i for i, (_, g) in groups.items() if i == g)
    three = stage[2](spark, two, SF).cache()
    left = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and all(r.n_chars == len(r.text) for r in left.values())
    for r in two.collect():
        assert ("[secret]" in left[r.doc_id].text) == bool(corpus_pipeline.secrets.spans_of(r.text.encode(), corpus_pipeline.secrets.SecretRules()))
    four = stage[3](spark, three, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(three).collect()}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == Counter({i: c for i, c in copies.items() if c})
    five = stage[4](spark, four, SF)
    assert five.count() == four.count() and five.where("n_tokens > 0").count() == four.count()


def test_queries_have_their_columns(spark):
    want = {"op1": "query_id rank vec_id score", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
            "op4": "doc_id n_assign n_access n_hex base_sha256 spans", "op5": "doc_id size source_size target taken", "op6": "page_id host path rule verdict",
            "op9": "page_id url text n_chars"}
    for name, make in queries.QUERIES.items():
        if (n := name.split("_")[0]) in want:
            df = make(spark, SF)
            assert set(want[n].split()) <= set(df.columns) and df.count() > 0, name


def test_log_bilinear_classes_tell_many_words_apart(spark):
    """The words with a class of their own are nearly half of all word occurrences of the given texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.coalesce("text", F.lit("")).cast("binary").alias("_bytes"))
    counts = sorted((r["c"] for r in logbilinear.word_counts(docs).collect()), reverse=True)
    assert sum(counts[:logbilinear.LblRules().classes]) > 0.45 * sum(counts)
