"""Archives, manifests and alignments against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomfold.lineage import keep
from loomfold.llm import crosstoken as ct, merkle, warc

PAGES = "page_id long, url string, html string"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


# -- archives ----------------------------------------------------------------

def plain_archive(rows):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    out, seen = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kind = "revisit" if (html or "") in seen else "response"
        seen.add(html or "")
        out.append((page, len(raw), digest, kind, first[html or ""] if kind == "revisit" else None))
    return sorted(out, key=str)


def archive_rows(df, **options):
    return sorted(((int(r.key) if r.key is not None else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.original) if r.original is not None else None)
                   for r in warc.archived(df, **options).collect()), key=str)


ODD_PAGES = [(1, "u1", "<p>x</p>"), (2, None, None), (3, "u3", ""), (4, "u\r\n4", "héllo\r\n\r\nWARC/1.1\r\nfoo"), (5, "é5", RECORD), (10, "u", "<p>x</p>"), (6, "u6", RECORD), (6, "u6", RECORD),
             (None, "n", "<p>x</p>"), (7, "big", "WARC/1.1\r\n" * 5000), (8, "y", " \r\n\r\n"), (9, "long", "word\n" * 400_000), (11, "z", "\r\n"), (12, "q", "WARC/1.1\r\n")]


def test_archives_give_back_every_payload(spark):
    df = spark.createDataFrame(ODD_PAGES, PAGES).repartition(3).withColumn("record_id", F.lit("x")).withColumn("_file", F.lit("y"))
    assert archive_rows(df) == plain_archive(ODD_PAGES)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_a_payload_on_a_third_of_all_pages_and_a_least_size(spark):
    rows = [(i, "u", "same" if i % 3 == 0 else f"page {i}") for i in range(600)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    assert archive_rows(df) == plain_archive(rows)
    assert all(r[3] == "response" for r in archive_rows(df, least=5))


def test_archives_are_valid_and_split_files_read_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"body {i}\r\n\r\n" * (i % 7) + RECORD * (i % 3 == 0)) for i in range(60)], PAGES).coalesce(1)
    warc.write_archive(warc.captured(df), str(tmp_path / "a"), compression="none")
    (part,) = (tmp_path / "a").glob("part-*")
    raw, at, found = part.read_bytes(), 0, 0
    while at < len(raw):                                                       # a plain reader: version, headers, so many bytes, two line breaks
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0][16:])
        at += len(head) + 4 + size
        assert raw[at:at + 4] == b"\r\n\r\n"
        at, found = at + 4, found + 1
    assert found == 60
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {int(r.key): bytes(r.payload).decode() for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {r.page_id: r.html for r in df.collect()}


def test_revisits_of_an_archive_follow_their_originals(spark, tmp_path):
    """Revisits that an archive holds already are resolved, also those of a record that itself becomes a revisit; lost originals stay lost."""
    ids = {k: f"urn:uuid:{k}" for k in "abcde"}
    rows = [(ids["a"], "response", "1", "same", None), (ids["b"], "response", "2", "same", None), (ids["c"], "revisit", "3", None, ids["b"]), (ids["d"], "revisit", "4", None, "urn:uuid:gone"),
            (ids["e"], "response", "5", "other", None)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, key string, body string, refers_to string")
    digest = F.coalesce(warc.payload_digest(F.col("body").cast("binary")), F.lit("LOST"))
    df = df.select("record_id", "record_type", "key", F.lit("http://x").alias("uri"), F.lit("2020-01-01T00:00:00Z").alias("date"), F.col("body").cast("binary").alias("payload"),
                   digest.alias("payload_digest"), "refers_to", F.lit(None).cast("string").alias("refers_uri"), F.lit(None).cast("string").alias("refers_date"))
    warc.write_archive(df, str(tmp_path / "in"))
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.key: r for r in warc.resolve(keep(warc.headers(warc.read_archive(spark, str(tmp_path / "out"))))).collect()}
    assert {k: (r.record_type, r.original, r.payload_bytes) for k, r in got.items()} == {
        "1": ("response", None, 4), "2": ("revisit", "1", 4), "3": ("revisit", "1", 4), "4": ("revisit", None, None), "5": ("response", None, 5)}
    assert got["4"].payload_digest == "LOST" and not {r.record_id for r in got.values()} & set(ids.values())


# -- manifests ---------------------------------------------------------------

def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"      # noqa: E731
    whole = lambda r, t: H("".join(map(framed, (r[0], r[3], r[2], r[4], t))))
    leaf = [whole(r, r[1]) for r in rows]
    hit = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None for r in rows]
    changed = [whole(r, r[1].replace("\n", "")) if h else x for r, h, x in zip(rows, hit, leaf)]
    paths, sub = {i: [] for i in range(len(rows))}, {}

    def climb(level):
        while len(level) > 1:
            above = []
            for k in range(0, len(level), 3):
                run = level[k:k + 3]
                for j, (_, below) in enumerate(run):
                    for i in below:
                        paths[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1:])))
                above.append((H("".join(x for x, _ in run)), sum((b for _, b in run), [])))
            level = above
        return level[0]

    tops = []
    for s in sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        tops.append(climb([(leaf[i], [i]) for i in own]))
        sub.update({i: tops[-1][0] for i in own})
    root, out = climb(tops)[0], []
    for i, r in enumerate(rows):
        state = changed[i]
        for a, b in paths[i]:
            state = H(a + state + b)
        out.append((r[0], leaf[i], sub[i], root, H("".join(a + b for a, b in paths[i])), state, state == root))
    return sorted(out, key=str)


def manifest_rows(df, rules=merkle.TreeRules()):
    found = merkle.manifest(keep(merkle.document_leaves(df)), "source", ["doc_id"], rules=rules)
    told = lambda c: F.lower(F.hex(c))                                          # noqa: E731
    proof = F.lower(F.array_join(F.transform("steps", lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), ""))
    folded = merkle.fold(F.col("tampered"), F.col("steps"))
    return sorted((tuple(r) for r in found.select("doc_id", told("leaf"), told("subroot"), told("root"), F.sha2(proof, 256), told(folded), folded == F.col("root")).collect()), key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [
    [(i % 37 if i % 5 else None, [None, "", "a\nb", "x"][i % 4], None if i % 3 else "en", [None, "", "é", "z", "hot", "hot", "hot"][i % 7], i % 3) for i in range(400)],
    [(5, "a\nb", "en", "s", 3)], [(5, "a\nb", "en", "s", 3), (6, "a", "en", "t", 3)], [(1, "a", "en", "s", 1)] * 100, [(i, "x\n" * i, "en", f"s{i}", i) for i in range(40)]],
    ids=["odd", "one", "two lone sources", "repeated rows", "many lone sources"])
def test_manifest(spark, rows):
    assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(3)) == plain_manifest(rows)


def test_manifest_without_broadcasts_one_level_at_a_time(spark):
    rows = [(i, f"text {i}\nline", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(260)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS), merkle.TreeRules(lift=1, broadcast_rows=0)) == plain_manifest(rows)


def test_manifest_of_awkward_tables(spark, odd, empty, clashing):
    assert manifest_rows(empty) == []
    assert manifest_rows(odd) == plain_manifest([tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    named = keep(merkle.document_leaves(clashing).withColumn("_row", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("_n", F.lit("n")))
    assert merkle.manifest(named, "source", ["doc_id"]).columns[:7] == ["doc_id", "source", "leaf", "tampered", "_row", "tree", "_n"]


# -- alignments --------------------------------------------------------------

def plain_alignment(rows, rules=ct.AlignRules()):
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(rules.ranks)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=rules.pieces)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    docs, count = [], Counter()
    for i, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b, raw = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
            one = [bytes(of[c] for c in t.id_to_token(k)) for k in a]
            two = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(one) != raw or b"".join(two) != raw:
                a, b = [], []
            else:
                x, y = np.cumsum(list(map(len, one))).tolist(), np.cumsum(list(map(len, two))).tolist()
                at, to, p, q = {e: k for k, e in enumerate(x)}, {e: k for k, e in enumerate(y)}, 0, 0
                for e in sorted(set(x) & set(y)):
                    groups.append((a[p:at[e] + 1], b[q:to[e] + 1]))
                    links.append((a[at[e]], b[to[e]]))
                    p, q = at[e] + 1, to[e] + 1
        count.update(links)
        docs.append((i, a, b, groups, links))
    best = Counter()
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    out = []
    for i, a, b, groups, links in docs:
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out, key=str)


ODD_TEXTS = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s> x </s><unk><0x0A>"), (6, "x" * 30000), (7, "\x00\x01 a\x85b　c"), (8, "🙂🙂 漢字 \r\n\t x"), (None, "no id"),
             (9, "ﬁ ﬃ Å é é"), (9, "ﬁ ﬃ Å é é"), (10, "\n\n  \n"), (11, "   lead"), (12, "wörd the " * 20000), (13, "ⅷ ꟃ 𞤀 ᲀ ½²")]


@pytest.mark.parametrize("rules", [ct.AlignRules(), ct.AlignRules(run_bytes=20_000, piece_ends=50)], ids=["registered", "many pieces"])
def test_alignment(spark, rules):
    got = ct.align(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").repartition(3), rules).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_alignment(ODD_TEXTS)


def test_alignment_of_the_given_documents(spark, documents, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ct.align(documents).collect()), key=str) == plain_alignment(rows)
    assert ct.align(empty).count() == 0 and ct.align(clashing).count() == clashing.count()


def test_groups_of_documents(spark):
    (r,) = ct.groups(spark.createDataFrame([(1, "unbelievable 12345")], "ids long, text string"), keep_columns=["ids"]).collect()
    a, b, a_bytes, b_bytes = ct._tokenizers(ct.AlignRules().ranks, ct.AlignRules().pieces)
    p = q = 0
    for g in r["groups"]:
        assert b"".join(a_bytes[i] for i in r["a_ids"][p:g["a"] + 1]) == b"".join(b_bytes[i] for i in r["b_ids"][q:g["b"] + 1])
        p, q = g["a"] + 1, g["b"] + 1
    assert (p, q) == (len(r["a_ids"]), len(r["b_ids"]))


ENDS = st.lists(st.integers(1, 60), unique=True, max_size=40).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.integers(1, 12))
def test_pieces_of_a_merge(a, b, size):
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    x, y = ct.diagonal_cuts(a, b, size)
    assert (x[0], y[0]) == (0, 0) and (x[-1], y[-1]) == (len(a), len(b)) and set(np.diff(x + y)[:-1].tolist()) <= {size}
    merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    for i, j in zip(x.tolist(), y.tolist()):
        assert [k for _, k in merged[:i + j]].count(0) == i
    p, q = ct.common_ends(a, b, size)
    assert a[p].tolist() == b[q].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
